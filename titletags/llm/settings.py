"""Production parameters of the queries and of the pipeline."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column
from pyspark.sql import functions as F

from titletags.llm.mixing import Mixture

PATTERN = public_tokenizers.PATTERN
VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
# Tokens of packed sequences, and the id that ends a document there.
WORD_PIECES = public_tokenizers.path("word_bpe_49k.json")
END_ID = 1
# Target mix of the given sources: five sources make a domain.
MIXTURE = Mixture(
    weights={
        ("d0",): 4, ("d1",): 3, ("d2",): 2, ("d3",): 1,
        **{(f"d{i}", "en"): 4 for i in range(4)},
        **{(f"d{i}", "de"): 2 for i in range(4)},
        ("d0", "en", "src0"): 3,
    },
    budget_parts=6, of_parts=10, max_epochs=4, seed=17,
)


def domain(source: str = "source") -> Column:
    """The domain of a source: its number by fives."""
    number = F.nullif(F.regexp_extract(source, "([0-9]+)$", 1), F.lit("")).try_cast("int")
    return F.concat(F.lit("d"), F.floor(number / 5).cast("string"))
