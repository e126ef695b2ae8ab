"""Sizes of texts in tokens of a public subword tokenizer."""

from __future__ import annotations

import base64
import os
import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Folder of the vocabulary files on every machine, and the byte-level vocabulary that is used.
TOKENIZER_DIR, VOCABULARY = "/opt/tokenizers", "byte_bpe_50k.tiktoken"
# Fixed value: the word pattern that belongs to this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Lines of a dialogue whose speaker only prompts; the other lines bear loss.
PROMPT_LINE = re.compile(r"(?m)^A:.*$\n?")
DIALOGUE = re.compile(r"(?m)^B:")


@lru_cache(maxsize=4)
def encoder(folder: str = TOKENIZER_DIR, vocabulary: str = VOCABULARY):
    import tiktoken

    with open(os.path.join(folder, vocabulary), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding(vocabulary, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def with_tokens(docs: DataFrame, folder: str = TOKENIZER_DIR) -> DataFrame:
    """(doc_id, source, tokens, loss_tokens) of whole texts; null texts have 0 tokens.

    In a dialogue (lines ``A:`` and ``B:``) the first speaker's lines are prompts and bear no loss;
    in any other text all tokens do.
    """
    def count(batches):
        enc = encoder(folder)
        for b in batches:
            n, loss = [], []
            for t in b["text"]:
                t = t if isinstance(t, str) else ""
                size = len(enc.encode_ordinary(t))
                said = size
                if DIALOGUE.search(t):
                    said = min(size, len(enc.encode_ordinary(PROMPT_LINE.sub("", t))))
                n.append(size)
                loss.append(said)
            yield pd.DataFrame({"doc_id": b["doc_id"], "source": b["source"], "tokens": n, "loss_tokens": loss})

    return docs.select("doc_id", F.col("source").cast("string"), "text").mapInPandas(count, "doc_id long, source string, tokens long, loss_tokens long")
