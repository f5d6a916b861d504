"""Line-first cleaning, in Spark expressions only.

Every line is judged by itself: punctuation, navigation and boilerplate rules.  Lines that fail
are removed, and a document that loses too many of its words is rejected.  The counts of symbols,
repeated lines and repeated three-word windows are taken over the whole text.

Edge cases: a null, empty or blank text has no words, no lines and fails by its length; a text of
any length is judged whole; a line without words is neither kept nor lost; repeated rows are judged
alike; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelweave.llm.common import SPACE, let, take, words

SYMBOLS = "#*$%&|<>"
#: Signs that stand between the entries of a menu.
SEPARATORS = "|»›•·"
#: Bits of a place in a text; longer texts are sorted by whole hashes.
PLACE_BITS = 20
#: Phrases of page furniture in English, German, Spanish and French; fixed values.
NOTICES = (
    "lorem ipsum", "enable javascript", "javascript is disabled", "cookie policy", "privacy policy", "terms of use", "terms of service", "all rights reserved",
    "datenschutzerklärung", "nutzungsbedingungen", "cookie-richtlinie", "alle rechte vorbehalten",
    "política de privacidad", "política de cookies", "términos de uso", "todos los derechos reservados",
    "politique de confidentialité", "politique de cookies", "conditions d'utilisation", "tous droits réservés",
)
#: Phrases that are furniture where little else stands on their line; fixed values.
LABELS = (
    "javascript", "sign up", "log in", "sign in", "subscribe", "click here", "read more", "share on", "skip to content", "add to cart",
    "anmelden", "registrieren", "weiterlesen", "mehr lesen", "hier klicken", "abonnieren", "teilen auf", "zum inhalt springen", "in den warenkorb", "impressum",
    "iniciar sesión", "registrarse", "suscríbete", "haz clic aquí", "leer más", "compartir en", "saltar al contenido", "añadir al carrito",
    "se connecter", "s'inscrire", "s'abonner", "cliquez ici", "lire la suite", "partager sur", "aller au contenu", "ajouter au panier",
)
#: Letters of a line that a notice or a label makes furniture, and words beside a label, at most.
NOTICE_LETTERS, LABEL_LETTERS, LABEL_WORDS = 300, 160, 8
#: A sentence ends with one of these, before closing quotes and brackets.
SENTENCE_END = r"[.!?:;…。！？؟][\"'”’»)\]]*(?:\s|$)"


def whole(phrases: tuple[str, ...]) -> str:
    """A pattern of phrases that no letter or digit goes on before or after."""
    return rf"(?:^|[^\p{{L}}\p{{N}}])(?:{'|'.join(phrases)})(?:[^\p{{L}}\p{{N}}]|$)"


def one_of(letters: str) -> str:
    return f"[{letters}]"


def repeated_words(own: Column, width: int = 3) -> Column:
    """How many words lie in ``width``-word windows that occur twice or more; ``own`` is a bound array of words.

    Windows are compared by 64-bit hashes.  Those that occur again are put in the order of the
    text; each adds the words that the one before does not cover.
    """
    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - width), lambda i: F.xxhash64(*[h[i + k] for k in range(width)]))

    hashed = F.transform(own, lambda w: F.xxhash64(w))

    def covered(places: Column) -> Column:
        start = F.struct(F.lit(0).alias("n"), F.lit(-width).alias("last"))
        return F.aggregate(places, start, lambda a, p: F.struct((a["n"] + F.least(F.lit(width), p - a["last"])).alias("n"), p.alias("last")), lambda a: a["n"])

    def again(s: Column, part: Callable[[Column], Column]) -> Column:
        """Of a sorted array, the elements whose part is that of a neighbour."""
        return F.filter(s, lambda x, k: F.coalesce(part(x) == part(F.get(s, k - 1)), F.lit(False)) | F.coalesce(part(x) == part(F.get(s, k + 1)), F.lit(False)))

    def exact(pairs: Column) -> Column:
        """Places in order, of pairs of hash and place, whose hash occurs again."""
        return let(F.sort_array(pairs), lambda s: F.sort_array(F.transform(again(s, lambda x: x["h"]), lambda x: x["i"])))

    def places(h: Column) -> Column:
        """Where windows are that occur again.

        The first bits of the hashes with the places behind them are sorted as numbers; only
        where these bits agree the whole hashes are compared.
        """
        near = F.transform(h, lambda x, i: x.bitwiseAND(F.lit(-1 << PLACE_BITS)).bitwiseOR(i.cast("long")))
        few = let(F.sort_array(near), lambda s: F.transform(again(s, lambda x: F.shiftright(x, PLACE_BITS)), lambda x: x.bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).cast("int")))
        some = F.transform(few, lambda i: F.struct(F.get(h, i).alias("h"), i.alias("i")))
        return exact(F.when(F.size(h) < 1 << PLACE_BITS, some).otherwise(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))))

    def counted(h: Column) -> Column:
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(places(h)))

    return F.when(F.size(own) > width, let(let(hashed, windows), counted)).otherwise(F.lit(0)).cast("long")


def any_of(text: Column, parts: tuple[str, ...]) -> Column:
    """Whether a text contains any of the parts; a loop over them, since a term for each would make a method too large to be compiled."""
    return let(text, lambda t: F.exists(F.array(*map(F.lit, parts)), lambda p: F.contains(t, p)))


def flags_of(text: Column) -> Column:
    """What a text has none of, none of its lines breaks a rule about."""
    return F.struct(text.rlike(one_of(SYMBOLS)).alias("symbols"), text.rlike(one_of(SEPARATORS)).alias("separators"))


def line_failed(line: Column, flags: Column, max_symbols: float = 0.1, min_words: int = 3) -> Column:
    """Whether a line with words breaks a rule; ``flags`` are those of its text, and spare most lines most rules."""
    symbols = flags["symbols"] & (F.regexp_count(line, F.lit(one_of(SYMBOLS))) > F.length(F.regexp_replace(line, SPACE, "")) * max_symbols)
    navigation = flags["separators"] & line.rlike(rf"(?:[{SEPARATORS}]\s*[^{SEPARATORS}]{{1,40}}){{3,}}")
    shouting = ~line.rlike("[a-z]") & (F.upper(line) == line) & (F.lower(line) != line) & (F.length(F.regexp_replace(line, r"[^\p{L}]", "")) >= 10)
    notice = (F.length(line) <= NOTICE_LETTERS) & any_of(F.lower(line), NOTICES) & F.lower(line).rlike(whole(NOTICES))
    label = (F.length(line) <= LABEL_LETTERS) & any_of(F.lower(line), LABELS) & F.lower(line).rlike(whole(LABELS)) & (F.size(F.array_remove(F.split(line, SPACE), "")) <= LABEL_WORDS)
    open_end = ~line.rlike(SENTENCE_END) & (F.size(F.array_remove(F.split(line, SPACE), "")) >= min_words)
    return symbols | navigation | shouting | notice | label | open_end


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50, max_repeats: int = 50, max_lost: float = 0.5) -> DataFrame:
    """``(id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_lost_words, clean_text)``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"\S"))
    read = take(docs, id=id_col, text=text_col).select("id", text.alias("_text"), words(text).alias("_words"), lines.alias("_lines"), flags_of(text).alias("_flags"))
    counted = read.select(
        "id",
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.when(F.col("_flags.symbols"), F.regexp_count("_text", F.lit(one_of(SYMBOLS)))).otherwise(0).cast("long").alias("n_symbols"),
        let(F.col("_lines"), lambda own: F.size(own) - F.size(F.array_distinct(own))).cast("long").alias("n_dup_lines"),
        let(F.col("_words"), lambda own: repeated_words(own)).alias("n_repeat_words"),
        F.transform("_lines", lambda x: F.struct(x.alias("line"), line_failed(x, F.col("_flags")).alias("failed"))).alias("_judged"),
    )
    # words are counted in the lines that go, which are few
    lost_words = F.aggregate(F.filter("_judged", lambda x: x["failed"]), F.lit(0).cast("long"), lambda n, x: n + F.size(F.array_remove(F.split(x["line"], SPACE), "")))
    failed = (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * max_repeats)
    lost = F.col("n_lost_words") > F.col("n_words") * max_lost
    clean = F.array_join(F.transform(F.filter("_judged", lambda x: ~x["failed"]), lambda x: x["line"]), "\n")
    counted = counted.withColumn("n_lost_words", lost_words)
    return counted.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & ~lost).alias("kept"), "n_lost_words", clean.alias("clean_text"))
