"""The queries of this package: one per operator, over its whole table."""
from __future__ import annotations

from .bpe import op6_bpe_round_trip
from .common import documents
from .imatch import op8_document_fingerprints
from .langid import op4_language_mixture
from .licenses import op9_license_scan
from .manifest import op11_merkle_manifest
from .oracles import ORACLES  # noqa: F401
from .packing import op5_harmonic_packing
from .pii import op1_pii_spans
from .repeats import op13_repeated_passages
from .search import op12_ranked_search
from .secrets import op3_secret_scan
from .setjoin import op10_jaccard_join
from .token_files import op7_token_files
from .vector_dups import op2_vector_near_duplicates

QUERIES = {
    "op1_pii_spans": lambda spark, d: op1_pii_spans(documents(spark, d)),
    "op2_vector_near_duplicates": lambda spark, d: op2_vector_near_duplicates(spark.read.parquet(f"{d}/embeddings.parquet")),
    "op3_secret_scan": lambda spark, d: op3_secret_scan(documents(spark, d)),
    "op4_language_mixture": lambda spark, d: op4_language_mixture(documents(spark, d)),
    "op5_harmonic_packing": lambda spark, d: op5_harmonic_packing(documents(spark, d)),
    "op6_bpe_round_trip": lambda spark, d: op6_bpe_round_trip(documents(spark, d)),
    "op7_token_files": lambda spark, d: op7_token_files(documents(spark, d)),
    "op8_document_fingerprints": lambda spark, d: op8_document_fingerprints(documents(spark, d)),
    "op9_license_scan": lambda spark, d: op9_license_scan(documents(spark, d)),
    "op10_jaccard_join": lambda spark, d: op10_jaccard_join(documents(spark, d)),
    "op11_merkle_manifest": lambda spark, d: op11_merkle_manifest(documents(spark, d)),
    "op12_ranked_search": lambda spark, d: op12_ranked_search(documents(spark, d), spark.read.parquet(f"{d}/benchmark.parquet")),
    "op13_repeated_passages": lambda spark, d: op13_repeated_passages(documents(spark, d)),
}
