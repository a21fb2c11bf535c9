"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from driftlens.llm.alignment import align_documents
from driftlens.llm.archives import archive_pages
from driftlens.llm.decontaminate import find_leaks
from driftlens.llm.exact import find_exact_duplicates
from driftlens.llm.extraction import extract_pages
from driftlens.llm.mixing import mix_documents
from driftlens.llm.neardup import find_near_duplicates
from driftlens.llm.packing import pack_documents
from driftlens.llm.pii import label_documents
from driftlens.llm.quality import score_documents
from driftlens.llm.secret_scan import scan_documents
from driftlens.llm.sql import ORACLE_SQL
from driftlens.llm.vectors import find_near_vectors
from driftlens.llm.whitening import whiten_embeddings

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_neardup": find_near_duplicates,
    "op2_packing": pack_documents,
    "op3_pii": label_documents,
    "op4_secrets": scan_documents,
    "op5_archives": archive_pages,
    "op6_decontaminate": find_leaks,
    "op7_vectors": find_near_vectors,
    "op8_mixing": mix_documents,
    "op9_extraction": extract_pages,
    "op10_quality": score_documents,
    "op11_alignment": align_documents,
    "op12_whitening": whiten_embeddings,
    "op13_exact": find_exact_duplicates,
}
__all__ = ["ORACLE_SQL", "QUERIES"]
