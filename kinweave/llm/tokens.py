"""Token counts under a public tokenizer. The vocabulary is read on the workers from a path; it is never trained or copied."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Ranks of a byte-level BPE vocabulary, one base64 token and its rank per line.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how that vocabulary splits text before merging bytes.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(2)
def encoder(path: str = VOCABULARY, split: str = SPLIT):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=split, mergeable_ranks=ranks, special_tokens={})


def _measure(path: str, split: str, with_ids: bool):
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, split)
        for b in batches:
            texts = b.column("text").to_pylist()
            count, lead, ids = [], [], []
            for i in range(0, len(texts), 256):
                chunk = [t or "" for t in texts[i : i + 256]]
                got = enc.encode_ordinary_batch(chunk, num_threads=1)
                heads = enc.encode_ordinary_batch([t.split("\n", 1)[0] if "\n" in t else "" for t in chunk], num_threads=1)
                count += map(len, got)
                lead += map(len, heads)
                if with_ids:
                    ids += [np.unique(np.asarray(g, np.int32)) for g in got]
            cols = [b.column(i) for i in range(b.num_columns - 1)] + [pa.array(count, pa.int32()), pa.array(lead, pa.int32())]
            names = [*b.schema.names[:-1], "n_tokens", "lead_tokens"]
            if with_ids:
                sizes = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                cols.append(pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return measure


def measured(docs: DataFrame, keep: list[str], path: str = VOCABULARY, split: str = SPLIT, with_ids: bool = False) -> DataFrame:
    """``keep`` columns with ``n_tokens``, ``lead_tokens`` (of the first line, 0 if there is only one) and, if asked for, the distinct token ``ids``.

    Rows with a null or empty text are left out. Texts are encoded whole.
    """
    rows = docs.filter("text is not null and text <> ''").select(*keep, "text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "text") + ", n_tokens int, lead_tokens int" + (", ids array<int>" if with_ids else "")
    return rows.mapInArrow(_measure(path, split, with_ids), schema)
