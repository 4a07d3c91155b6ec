"""Registered queries of the training-data operators and, where SQL can say the same, their SQL."""

import corpus_pipeline
from leafmill.llm.ann_search import op3_ann_search
from leafmill.llm.manifest import OP12_SQL, op12_merkle_manifest
from leafmill.llm.minhash_dedup import op4_minhash_dedup
from leafmill.llm.mixing import OP7_SQL, op7_mix_sources
from leafmill.llm.packing import op2_best_fit_packing
from leafmill.llm.quality_model import op11_quality_classifier
from leafmill.llm.quality_rules import OP1_SQL, op1_quality_rules
from leafmill.llm.secret_scan import op9_secret_scan
from leafmill.llm.spelling import OP13_SQL, op13_spelling_variants
from leafmill.llm.suffix_dedup import op5_suffix_dedup
from leafmill.llm.toxicity import op10_toxicity
from leafmill.llm.url_filters import OP8_SQL, op8_url_filters
from leafmill.llm.warc import OP6_SQL, op6_warc

QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_ann_search": op3_ann_search,
    "op4_minhash_dedup": op4_minhash_dedup,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_warc": op6_warc,
    "op7_mix_sources": op7_mix_sources,
    "op8_url_filters": op8_url_filters,
    "op9_secret_scan": op9_secret_scan,
    "op10_toxicity": op10_toxicity,
    "op11_quality_classifier": op11_quality_classifier,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_spelling_variants": op13_spelling_variants,
    "pipeline": corpus_pipeline.run,
}
ORACLE_SQL = {
    "op1_quality_rules": OP1_SQL,
    "op6_warc": OP6_SQL,
    "op7_mix_sources": OP7_SQL,
    "op8_url_filters": OP8_SQL,
    "op12_merkle_manifest": OP12_SQL,
    "op13_spelling_variants": OP13_SQL,
}
