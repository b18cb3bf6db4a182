"""The queries opN_<name> and, where SQL can express one, its DuckDB text.

Operators 1, 4, 5 and 9 are models and samplers, 3 votes on spans, and 10 hashes with XXH64 of a seed; no SQL says
those, so tests hold them against brute force, exact round trips or held-out labels.
"""

from __future__ import annotations

from . import ann_tiles, gumbel_pieces, langid_fusion, license_diagonals, line_mphf, quality_crf, range_max_search, rtree_negatives, simhash_bk, spaced_decontam, split_mixing, toxicity_cnn, url_cascade


def queries() -> dict:
    return {
        "op1_quality_crf": quality_crf.query,
        "op2_ann_tiles": ann_tiles.query,
        "op3_license_diagonals": license_diagonals.query,
        "op4_toxicity_cnn": toxicity_cnn.query,
        "op5_langid_fusion": langid_fusion.query,
        "op6_url_cascade": url_cascade.query,
        "op7_spaced_decontam": spaced_decontam.query,
        "op8_line_mphf": line_mphf.query,
        "op9_gumbel_pieces": gumbel_pieces.query,
        "op10_simhash_bk": simhash_bk.query,
        "op11_split_mixing": split_mixing.query,
        "op12_rtree_negatives": rtree_negatives.query,
        "op13_range_max_search": range_max_search.query,
    }


def oracle_sql() -> dict:
    return {
        "op2_ann_tiles": ann_tiles.ORACLE,
        "op6_url_cascade": url_cascade.ORACLE,
        "op7_spaced_decontam": spaced_decontam.ORACLE,
        "op8_line_mphf": line_mphf.ORACLE,
        "op11_split_mixing": split_mixing.ORACLE,
        "op12_rtree_negatives": rtree_negatives.ORACLE,
        "op13_range_max_search": range_max_search.ORACLE,
    }
