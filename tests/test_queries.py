"""Registered queries beside DuckDB on the smallest tables. VERDIGRIS_ALL=1 runs every one."""

import os

import pytest

from oracle_check import compare, connect
from verdigris.plans import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
QUICK = [
    "a2_publication_rates", "a5_chi_square", "a14_caliper_naive", "a22_gap_decomposition", "a28_probit", "a47_weighted_kappa",
    "f8_control_variables", "j6_fuzzy_title_join", "j13_word_containment", "j19_location_links", "j22_strategy_cascade",
    "p16_internal_consistency", "s3_statistics_json", "s12_heading_layout", "s16_session_filtered_layout",
    "t1_streamed_upsert", "w6_page_window", "x1_normalise_title", "x18_parse_replies", "x19_repair_arrays",
    "a18_within_window_draws", "a33_wald_symmetry", "a52_false_negative_rate", "j16_partial_ratio_check", "s14_dashed_layout",
    "s18_whole_text_files", "x5_programme_surnames", "x12_score_variants", "x23_abstract_block",
]
NAMES = sorted(ORACLES) if os.environ.get("VERDIGRIS_ALL") else QUICK


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    assert compare(QUERIES[name](spark, SF), con, ORACLES[name]) is None


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
