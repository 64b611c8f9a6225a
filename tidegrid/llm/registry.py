"""Queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from . import decontaminate, fim, jaccard, language, license, media, merkle, packing, quality, simhash, sql, substring, suffix, url_filter

QUERIES = {
    f.__name__: f
    for f in (
        url_filter.op1_url_filter, quality.op2_quality, substring.op3_substring, suffix.op4_suffix_dedup, media.op5_media_columns, language.op6_language, packing.op7_packing, decontaminate.op8_decontamination, license.op9_license, jaccard.op10_jaccard_join,
        merkle.op11_merkle_manifest, simhash.op12_simhash, fim.op13_fill_in_middle,
    )
}

SQL = {"op1_url_filter": url_filter.oracle(), "op3_substring": sql.SUBSTRING, "op4_suffix_dedup": sql.SUFFIX, "op9_license": license.oracle(), "op10_jaccard_join": sql.JACCARD, "op11_merkle_manifest": sql.MERKLE, "op13_fill_in_middle": sql.FIM}
