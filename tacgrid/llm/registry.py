"""The corpus queries by name, and the SQL of those that SQL can express."""

from tacgrid.llm.chat import OP5_SQL, op5_chat
from tacgrid.llm.decontaminate import OP1_SQL, op1_decontaminate
from tacgrid.llm.linededup import OP6_SQL, op6_line_dedup
from tacgrid.llm.media import op2_media
from tacgrid.llm.mixing import op7_mixing
from tacgrid.llm.pii import op3_pii
from tacgrid.llm.prefixtrie import OP12_SQL, op12_trie
from tacgrid.llm.quality import op4_quality
from tacgrid.llm.simhash import op9_simhash
from tacgrid.llm.suffixdedup import op10_repeats
from tacgrid.llm.tokencounts import op13_tokens
from tacgrid.llm.toxicity import op8_toxicity
from tacgrid.llm.whitening import op11_whitening

QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_media": op2_media,
    "op3_pii": op3_pii,
    "op4_quality": op4_quality,
    "op5_chat": op5_chat,
    "op6_line_dedup": op6_line_dedup,
    "op7_mixing": op7_mixing,
    "op8_toxicity": op8_toxicity,
    "op9_simhash": op9_simhash,
    "op10_repeats": op10_repeats,
    "op11_whitening": op11_whitening,
    "op12_trie": op12_trie,
    "op13_tokens": op13_tokens,
}

SQL = {
    "op1_decontaminate": OP1_SQL,
    "op5_chat": OP5_SQL,
    "op6_line_dedup": OP6_SQL,
    "op12_trie": OP12_SQL,
}
