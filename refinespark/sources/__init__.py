from .tables import (read_table, read_pairs_csv, conversation_pairs, passages, utterances,
                     vectors, vector_pairs, corpus_profile, with_position)

__all__ = ["read_table", "read_pairs_csv", "conversation_pairs", "passages", "utterances",
           "vectors", "vector_pairs", "corpus_profile", "with_position"]
