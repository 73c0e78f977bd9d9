"""Queries of this package's operators, each over its whole tables."""

from __future__ import annotations

from litspark.llm import answers, lookalikes, mixing, names, nearcopies, packing, quality, spans, splitting

QUERIES = {
    "p1_found": nearcopies.p1_found,
    "p1_groups": nearcopies.p1_groups,
    "p2_found": spans.p2_found,
    "p2_overlap": spans.p2_overlap,
    "p2_passages": spans.p2_passages,
    "p3_found": lookalikes.p3_found,
    "p3_normal": lookalikes.p3_normal,
    "p4_found": answers.p4_found,
    "p5_entities": names.p5_entities,
    "p5_found": names.p5_found,
    "p6_found": splitting.p6_found,
    "p6_pieces": splitting.p6_pieces,
    "p6_rejoined": splitting.p6_rejoined,
    "p7_found": packing.p7_found,
    "p7_documents": packing.p7_documents,
    "p7_limits": packing.p7_limits,
    "p7_packed": packing.p7_packed,
    "p7_pairs": packing.p7_pairs,
    "p8_found": mixing.p8_found,
    "p8_expected": mixing.p8_expected,
    "p8_margins": mixing.p8_margins,
    "p8_mix": mixing.p8_mix,
    "p8_shares": mixing.p8_shares,
    "p9_found": quality.p9_found,
    "p9_stats": quality.p9_stats,
}

#: DuckDB SQL of the queries that SQL can express over whole tables.
ORACLE: dict[str, str] = {
    "p2_found": spans.P2_FOUND_SQL,
    "p2_overlap": spans.P2_OVERLAP_SQL,
    "p6_found": splitting.P6_FOUND_SQL,
    "p6_rejoined": splitting.P6_REJOINED_SQL,
    "p7_found": packing.P7_FOUND_SQL,
    "p7_documents": packing.P7_DOCUMENTS_SQL,
    "p7_limits": packing.P7_LIMITS_SQL,
    "p8_expected": mixing.P8_EXPECTED_SQL,
    "p8_found": mixing.P8_FOUND_SQL,
}
