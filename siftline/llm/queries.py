"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from .bpe import op8_bpe
from .lexical import OP13_SQL, op13_lexical
from .lines import OP12_SQL, op12_lines
from .maxent import op1_maxent
from .mixing import OP2_SQL, op2_mix
from .neardup import op9_neardup
from .pages import op3_pages
from .quality import OP6_SQL, op6_quality
from .secrets import op7_secrets
from .substrings import op5_substrings
from .tokenfile import op10_tokens
from .turns import op11_turns
from .vectors import op4_vectors

QUERIES = {f.__name__: f for f in (op1_maxent, op2_mix, op3_pages, op4_vectors, op5_substrings, op6_quality, op7_secrets, op8_bpe, op9_neardup, op10_tokens, op11_turns, op12_lines, op13_lexical)}
ORACLE_SQL = {"op2_mix": OP2_SQL, "op6_quality": OP6_SQL, "op12_lines": OP12_SQL, "op13_lexical": OP13_SQL}
