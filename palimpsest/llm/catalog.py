"""Queries of the text operators and the SQL they are held against."""

from __future__ import annotations

import corpus_pipeline

from .decontaminate import OP6_SQL, op6_decontamination
from .exact_dedup import OP7_SQL, op7_exact_dedup
from .language_id import op10_language_id
from .language_model import op4_language_model
from .line_dedup import OP2_SQL, op2_line_dedup
from .mixing import OP9_SQL, op9_mixing
from .ngram_join import OP3_SQL, op3_ngram_join
from .packing import op8_packing
from .secret_scan import op5_secret_scan
from .suffix_dedup import OP1_SQL, op1_suffix_dedup


def queries() -> dict:
    return {
        "op1_suffix_dedup": op1_suffix_dedup,
        "op2_line_dedup": op2_line_dedup,
        "op3_ngram_join": op3_ngram_join,
        "op4_language_model": op4_language_model,
        "op5_secret_scan": op5_secret_scan,
        "op6_decontamination": op6_decontamination,
        "op7_exact_dedup": op7_exact_dedup,
        "op8_packing": op8_packing,
        "op9_mixing": op9_mixing,
        "op10_language_id": op10_language_id,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_suffix_dedup": OP1_SQL, "op2_line_dedup": OP2_SQL, "op3_ngram_join": OP3_SQL, "op6_decontamination": OP6_SQL, "op7_exact_dedup": OP7_SQL, "op9_mixing": OP9_SQL}
