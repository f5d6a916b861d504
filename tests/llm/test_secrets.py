import math
from itertools import combinations

import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st

from parcelweave.llm import secrets

WORDS = ("password", "abc", "dog", "an", "secret")


def segment(value, dictionary):
    """The least cost of a value as one segment, by trying each kind."""
    plain, n = value.lower(), len(value)
    sizes = [math.log10(secrets._alphabet(c)) for c in value]
    costs = [sizes[0]] if n == 1 else []
    capitals = sum(c.isupper() for c in value)
    more = 0 if not capitals else 0.3 if capitals in (1, n) else math.log10(math.comb(n, capitals) + 1)
    for rank, word in enumerate(dictionary):
        for form, extra in ((plain, 0), (plain.translate(secrets.LEET), 0.6), (plain[::-1], 0.3)):
            if form == word and n > 1:
                costs.append(math.log10(rank + 2) + extra + more + secrets.JOIN)
    if secrets.DATE.fullmatch(value):
        costs.append(math.log10(365 * 120) + secrets.JOIN)
    for p in range(1, 9):
        times = n // p
        if times * p == n and times >= (3 if p == 1 else 2) and plain[:p] * times == plain:
            costs.append(sum(sizes[:p]) + math.log10(times) + secrets.JOIN)
    if n >= 3 and all(pair in secrets.NEXT for pair in zip(plain, plain[1:])):
        costs.append(1 + sizes[0] + math.log10(n) + secrets.JOIN)
    return min(costs, default=math.inf)


def brute(value, dictionary):
    """The least over all segmentations."""
    best = math.inf
    for k in range(len(value)):
        for cuts in combinations(range(1, len(value)), k):
            bounds = (0, *cuts, len(value))
            best = min(best, sum(segment(value[a:b], dictionary) for a, b in zip(bounds, bounds[1:])))
    return best


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "ab", "abc", "dog", "d0g", "god", "1", "12", "2019", "q", "w", "we", "Z", "!", "an", "aa"]), min_size=1, max_size=6).map(lambda x: "".join(x)[:10]))
@example("aaaaaaaaaa")
@example("ababababab")
@example("dogaaaabb1")
@example("qwertasdfg")
@example("abcabcabca")
def test_least_of_all_segmentations(value):
    assert secrets.Guesser(WORDS).log10(value) == pytest.approx(brute(value, WORDS))


def test_long_values():
    """No switch by length: a long value costs what its parts cost."""
    g = secrets.Guesser(WORDS)
    for block in ("ab", "a", "x7!qP2zz"):
        long = block * 4000
        assert g.log10(long) == pytest.approx(segment(long, WORDS))
    noise = "xK9#mQ2$vL7!"
    assert g.log10("a" * 30_000 + noise + "dog" + "b" * 500) <= segment("a" * 30_000, WORDS) + g.log10(noise) + segment("dog", WORDS) + segment("b" * 500, WORDS) + 1e-9


def test_dictionary():
    words = secrets.ranked_words()
    assert len(words) > 20_000 and words[: len(secrets.COMMON)] == secrets.COMMON and len(set(words)) == len(words)
    g = secrets.Guesser(words)
    assert g.log10("authentication") < 6 and g.log10("correcthorsebatterystaple") < 20 and g.log10("xK9#mQ2$vL7!") > 15
    found = secrets.Finder(dictionary=words)("token: authentication, secret = Conglomerate; passphrase: amplification")
    assert [s for s in found if s[0] == "credential"] == []
    assert secrets.ranked_words(()) == secrets.COMMON
    with pytest.raises(FileNotFoundError):  # never another dictionary without a word
        secrets.ranked_words(("/nowhere",))


@pytest.mark.parametrize(
    ("text", "value"),
    [
        ('password="Zq8!,vT2mLw9Xe"', "Zq8!,vT2mLw9Xe"),
        ('password="aB3,xY9(kQ)z7"', "aB3,xY9(kQ)z7"),
        ("{'pwd': 'k;9 <Lq\"2v', 'n': 1}", "k;9 <Lq\"2v"),
        (r'secret := "a\"9,Kx72!w"', r"a\"9,Kx72!w"),
        ("Authorization: Bearer mF_9.B5f-4.1JqM", "mF_9.B5f-4.1JqM"),
        ("authorization: bearer qhwkzjvxmrtp", "qhwkzjvxmrtp"),
        ("a bearer mF_9.B5f-4.1JqM here", "mF_9.B5f-4.1JqM"),
        ("mysql --password Zq8!vT2mLw9Xe -u x", "Zq8!vT2mLw9Xe"),
        ('password="Zq8!vT2mLw9Xe, unclosed', "Zq8!vT2mLw9Xe"),
        ("password=Zq8!vT2mLw9Xe, next", "Zq8!vT2mLw9Xe"),
    ],
)
def test_whole_values(text, value):
    found = [text[a:b] for kind, a, b in secrets.Finder()(text) if kind == "credential"]
    assert found == [value]


@pytest.mark.parametrize("text", ['password="password, 123456"', "the bearer certificates. And bearer Certificates", "--password admin", "bearer of this"])
def test_cheap_values(text):
    assert secrets.Finder()(text) == []
