"""Queries of the operators on documents (p6 to p8)."""

from __future__ import annotations

from barloom.llm.leakage import leaked_items
from barloom.llm.subjects import document_subjects, subject_thresholds
from barloom.llm.tokens import encode_corpus
from barloom.session import read_table

QUERIES = {
    "p6_ids": lambda s, d: encode_corpus(read_table(s, d, "documents")),
    "p7_found": lambda s, d: leaked_items(read_table(s, d, "documents"), read_table(s, d, "eval_items")).where("distance = 0").select("doc_id", "item_id"),
    "p8_found": lambda s, d: document_subjects(read_table(s, d, "documents"), read_table(s, d, "subject_examples")).select("doc_id", "subject"),
    "p8_thresholds": lambda s, d: subject_thresholds(read_table(s, d, "subject_examples")),
}

SQL: dict[str, str] = {}
