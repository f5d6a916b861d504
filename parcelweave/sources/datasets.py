"""The raw datasets: names, files and columns.  Every raw column is text; types are given when a column is read.

The column names are fixed values of the published files.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

PARCELS = """
pin pin10 year class triad_name triad_code township_name township_code nbhd_code tax_code zip_code lon lat x_3435 y_3435 census_block_group_geoid
census_block_geoid census_congressional_district_geoid census_congressional_district_num census_county_subdivision_geoid census_place_geoid
census_puma_geoid census_school_district_elementary_geoid census_school_district_secondary_geoid census_school_district_unified_geoid
census_state_representative_geoid census_state_representative_num census_state_senate_geoid census_state_senate_num census_tract_geoid
census_zcta_geoid census_data_year census_acs5_congressional_district_geoid census_acs5_congressional_district_num
census_acs5_county_subdivision_geoid census_acs5_place_geoid census_acs5_puma_geoid census_acs5_school_district_elementary_geoid
census_acs5_school_district_secondary_geoid census_acs5_school_district_unified_geoid census_acs5_state_representative_geoid
census_acs5_state_representative_num census_acs5_state_senate_geoid census_acs5_state_senate_num census_acs5_tract_geoid census_acs5_data_year
cook_board_of_review_district_num cook_board_of_review_district_data_year cook_commissioner_district_num cook_commissioner_district_data_year
cook_judicial_district_num cook_judicial_district_data_year cook_municipality_num cook_municipality_name cook_municipality_data_year ward_num
ward_chicago_data_year ward_evanston_data_year chicago_community_area_num chicago_community_area_name chicago_community_area_data_year
chicago_industrial_corridor_num chicago_industrial_corridor_name chicago_industrial_corridor_data_year chicago_police_district_num
chicago_police_district_data_year econ_coordinated_care_area_num econ_coordinated_care_area_data_year econ_enterprise_zone_num
econ_enterprise_zone_data_year econ_industrial_growth_zone_num econ_industrial_growth_zone_data_year econ_qualified_opportunity_zone_num
econ_qualified_opportunity_zone_data_year econ_central_business_district_num econ_central_business_district_data_year env_flood_fema_sfha
env_flood_fema_data_year env_flood_fs_factor env_flood_fs_risk_direction env_flood_fs_data_year env_ohare_noise_contour_no_buffer_bool
env_ohare_noise_contour_half_mile_buffer_bool env_ohare_noise_contour_data_year env_airport_noise_dnl env_airport_noise_data_year
school_elementary_district_geoid school_elementary_district_name school_secondary_district_geoid school_secondary_district_name
school_unified_district_geoid school_unified_district_name school_school_year school_data_year tax_municipality_num tax_municipality_name
tax_school_elementary_district_num tax_school_elementary_district_name tax_school_secondary_district_num tax_school_secondary_district_name
tax_school_unified_district_num tax_school_unified_district_name tax_community_college_district_num tax_community_college_district_name
tax_fire_protection_district_num tax_fire_protection_district_name tax_library_district_num tax_library_district_name tax_park_district_num
tax_park_district_name tax_sanitation_district_num tax_sanitation_district_name tax_special_service_area_num tax_special_service_area_name
tax_tif_district_num tax_tif_district_name tax_data_year access_cmap_walk_id access_cmap_walk_nta_score access_cmap_walk_total_score
access_cmap_walk_data_year misc_subdivision_id misc_subdivision_data_year row_id
"""
OWNERS = """
pin pin10 year prop_address_full prop_address_city_name prop_address_state prop_address_zipcode_1 mail_address_name mail_address_full
mail_address_city_name mail_address_state mail_address_zipcode_1 row_id
"""
PERMITS = """
id permit_ permit_status permit_milestone permit_type review_type application_start_date issue_date processing_time street_number street_direction
street_name work_type work_description permit_condition building_fee_paid zoning_fee_paid other_fee_paid subtotal_paid building_fee_unpaid
zoning_fee_unpaid other_fee_unpaid subtotal_unpaid building_fee_waived building_fee_subtotal zoning_fee_subtotal other_fee_subtotal zoning_fee_waived
other_fee_waived subtotal_waived total_fee %s reported_cost pin_list community_area census_tract ward xcoordinate ycoordinate latitude
longitude location
""" % " ".join(f"contact_{i}_{part}" for i in range(1, 16) for part in ("type", "name", "city", "state", "zipcode"))
VIOLATIONS = """
id violation_last_modified_date violation_date violation_code violation_status violation_status_date violation_description violation_location
violation_inspector_comments violation_ordinance inspector_id inspection_number inspection_status inspection_waived inspection_category
department_bureau address street_number street_direction street_name street_type property_group ssa latitude longitude location
"""
REQUESTS = """
sr_number sr_type sr_short_code created_department owner_department status origin created_date last_modified_date closed_date street_address city
state zip_code street_number street_direction street_name street_type duplicate legacy_record legacy_sr_number parent_sr_number community_area ward
electrical_district electricity_grid police_sector police_district police_beat precinct sanitation_division_days created_hour created_day_of_week
created_month x_coordinate y_coordinate latitude longitude location
"""
GEOGRAPHIES = """
geo_type area_num_1 area_numbe community edit_date globalid objectid shape_area shape_len st_area_sh st_length_ the_geom ward ward_id zip
"""


@dataclass(frozen=True)
class DatasetSpec:
    """A raw table and the columns that its CSV file may have."""

    name: str
    columns: tuple[str, ...]

    @property
    def file(self) -> str:
        return f"{self.name}.csv"

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(c, T.StringType()) for c in self.columns])


DATASETS = {
    name: DatasetSpec(name, tuple(columns.split()))
    for name, columns in (
        ("chi_parcels", PARCELS),
        ("chi_owners", OWNERS),
        ("chi_permits", PERMITS),
        ("chi_violations", VIOLATIONS),
        ("chi_311", REQUESTS),
        ("chi_geographies", GEOGRAPHIES),
    )
}
#: Two small files of events by parcel.
INLINE = {
    "requests": DatasetSpec("chi_311", ("pin", "request_date", "request_type", "status")),
    "violations": DatasetSpec("chi_violations", ("pin", "violation_date", "status", "category")),
}
#: Private files that are loaded by position.
POSITIONAL = {
    "signature_unhp_buildings": ("bbl", "loan_pool", "landlord", "bip", "water_charges", "origination_date", "debt_total"),
    "signature_unhp_loan_status": ("bbl", "action", "date", "url", "label"),
}
POSITIONAL["oca_addresses_with_bbl"] = (
    "indexnumberid city state postalcode borough_code place_name boro cd ct bct2020 bctcb2020 ct2010 cb2010 council grc grc2 msg msg2 unitsres bbl"
).split()
