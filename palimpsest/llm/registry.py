"""The corpus queries and their SQL."""

from __future__ import annotations

from .collocations import OP13_SQL, op13_collocations
from .decontaminate import op1_decontamination
from .exactdedup import OP8_SQL, op8_exact_dedup
from .language import op3_language_id
from .linededup import OP10_SQL, op10_line_dedup
from .mixing import op4_mixing
from .ngramscore import OP2_SQL, op2_lm_score
from .secretscan import op9_secret_scan
from .simhash import op7_simhash
from .tokencount import op11_token_count
from .tokens import op5_token_output
from .vectorcodes import OP12_SQL, op12_vector_codes
from .warc import OP6_SQL, op6_warc

QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_lm_score": op2_lm_score,
    "op3_language_id": op3_language_id,
    "op4_mixing": op4_mixing,
    "op5_token_output": op5_token_output,
    "op6_warc": op6_warc,
    "op7_simhash": op7_simhash,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_secret_scan": op9_secret_scan,
    "op10_line_dedup": op10_line_dedup,
    "op11_token_count": op11_token_count,
    "op12_vector_codes": op12_vector_codes,
    "op13_collocations": op13_collocations,
}

ORACLE_SQL = {
    "op2_lm_score": OP2_SQL,
    "op6_warc": OP6_SQL,
    "op8_exact_dedup": OP8_SQL,
    "op10_line_dedup": OP10_SQL,
    "op12_vector_codes": OP12_SQL,
    "op13_collocations": OP13_SQL,
}
