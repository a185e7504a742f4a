"""Queries of the training-data operators, by problem, and the SQL of those SQL can express."""

from __future__ import annotations

from . import bpe, canon, pack, pairs, reading, scan, sentences, split, topn

QUERIES = {
    "p1_found": pairs.p1_found,
    "p1_rules": pairs.p1_rules,
    "p2_found": scan.p2_found,
    "p2_repaired": scan.p2_repaired,
    "p3_found": split.p3_found,
    "p3_pieces": split.p3_pieces,
    "p4_found": sentences.p4_found,
    "p4_sentences": sentences.p4_sentences,
    "p5_found": topn.p5_found,
    "p7_found": canon.p7_found,
    "p7_classes": canon.p7_classes,
    "p7_canonical": canon.p7_canonical,
    "p8_ids": bpe.p8_ids,
    "p9_containers": pack.p9_containers,
    "p9_fill": pack.p9_fill,
    "p10_found": reading.p10_found,
}

ORACLE_SQL = {"p3_found": split.P3_FOUND_SQL, "p5_found": topn.P5_SQL}
