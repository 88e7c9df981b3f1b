from .text import (BOS, EOS, wrap, strip_blank, gold_prompt, refine_prompt, vocab_tokens,
                   encoder_tokens, hash32, seeded_unit)
from .vectors import dot, l2sq, vec_sum, rounded

__all__ = ["BOS", "EOS", "wrap", "strip_blank", "gold_prompt", "refine_prompt", "vocab_tokens",
           "encoder_tokens", "hash32", "seeded_unit", "dot", "l2sq", "vec_sum", "rounded"]
