"""The queries of the training-data operators and, where SQL can express them, their DuckDB twins."""

from __future__ import annotations

from .centroid_clusters import OP11_SQL, op11_centroid_clusters
from .chat_format import op2_chat_format
from .collocations import OP13_SQL, op13_collocations
from .decontaminate import op5_decontaminate
from .fingerprints import op6_document_fingerprints
from .line_dedup import OP3_SQL, op3_line_dedup
from .mixing import OP9_SQL, op9_mix_sources
from .prob_minhash import op7_near_duplicates
from .substring_dedup import OP1_SQL, op1_substring_dedup
from .suffix_dedup import op8_suffix_dedup
from .token_counts import op12_token_counts
from .toxicity import op4_toxicity
from .warc import OP10_SQL, op10_warc_transactions



def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_chat_format": op2_chat_format,
    "op3_line_dedup": op3_line_dedup,
    "op4_toxicity": op4_toxicity,
    "op5_decontaminate": op5_decontaminate,
    "op6_document_fingerprints": op6_document_fingerprints,
    "op7_near_duplicates": op7_near_duplicates,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_mix_sources": op9_mix_sources,
    "op10_warc_transactions": op10_warc_transactions,
    "op11_centroid_clusters": op11_centroid_clusters,
    "op12_token_counts": op12_token_counts,
    "op13_collocations": op13_collocations,
    "pipeline": pipeline,
}

ORACLES = {
    "op1_substring_dedup": OP1_SQL,
    "op3_line_dedup": OP3_SQL,
    "op9_mix_sources": OP9_SQL,
    "op10_warc_transactions": OP10_SQL,
    "op11_centroid_clusters": OP11_SQL,
    "op13_collocations": OP13_SQL,
}
