"""Exact token counts of texts of any length by overlap resynchronisation.

A text up to ``chunk`` characters is encoded at once. A longer one is encoded in
overlapping chunks, with character offsets. Two neighbouring encodings are
spliced at a position of their overlap that is proven stable: a white-space
character follows a non-white-space one there (no pre-token of these byte-level
vocabularies spans such a place, and what precedes it never changes what
follows), both encodings begin a token there, and neither is within a special
string. Where no such position exists the overlap is doubled, up to the whole
rest of the text, so the result always equals that of encoding the whole text.

Defined results: null and empty texts have 0 bytes and 0 tokens; repeated rows
are counted one by one; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_rows, texts_of

CHUNK, OVERLAP = 1 << 16, 256
#: A place where a space or line feed follows a character that no definition counts as white space.
_PLACE = re.compile(r"(?<=\S)(?=[ \n])")
_LOADED: dict[str, object] = {}


def tokenizer(path: str):
    """The library's object for ``path``, loaded once per worker."""
    if path not in _LOADED:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if path.endswith(".model"):
            import sentencepiece

            _LOADED[path] = sentencepiece.SentencePieceProcessor(model_file=path)
        else:
            from tokenizers import Tokenizer

            loaded = Tokenizer.from_file(path)
            loaded.no_padding()
            loaded.no_truncation()
            _LOADED[path] = loaded
    return _LOADED[path]


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def count_long(encode, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of ``text`` by overlapping chunks. ``encode(part)`` gives the character offset at which each token starts."""
    total, begin = 0, 0
    starts = encode(text[:chunk])
    end = min(chunk, len(text))
    while end < len(text):
        width = overlap
        while True:
            low = max(begin + 1, end - width)
            if low <= begin + 1 or width > chunk:
                # no stable place in this chunk: let the chunk itself grow
                end = min(len(text), begin + 2 * (end - begin))
                starts = encode(text[begin:end])
                if end >= len(text):
                    return total + len(starts)
                width = overlap
                continue
            following_end = min(len(text), low + chunk)
            following = encode(text[low:following_end])
            place = _splice(text, begin, starts, low, following, end)
            if place is not None:
                total += int(np.searchsorted(starts, place - begin))
                starts = following[np.searchsorted(following, place - low) :] - (place - low)
                begin, end = place, following_end
                break
            width *= 2
    return total + len(starts)


def _splice(text: str, begin: int, left: np.ndarray, low: int, right: np.ndarray, end: int) -> int | None:
    """The last stable place where both encodings begin a token."""
    places = [m.start() for m in _PLACE.finditer(text, low + 1, end - 1)]
    for place in reversed(places):
        a, b = np.searchsorted(left, place - begin), np.searchsorted(right, place - low)
        if a < len(left) and left[a] == place - begin and b < len(right) and right[b] == place - low:
            return place
    return None


def _starts(t):
    return lambda part: np.fromiter((o[0] for o in t.encode(part, add_special_tokens=False).offsets), dtype=np.int64)


def count_tokens(texts: list[str], path: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
    t = tokenizer(path)
    if path.endswith(".model"):
        # This kind reads a text as a whole (its normaliser joins white space): no place is proven stable.
        return [len(x) for x in t.encode(texts, num_threads=1)]
    short = [k for k, x in enumerate(texts) if len(x) <= chunk]
    out = [0] * len(texts)
    for k, e in zip(short, t.encode_batch_fast([texts[k] for k in short], add_special_tokens=False), strict=True):
        out[k] = len(e)
    encode = _starts(t)
    for k, x in enumerate(texts):
        if len(x) > chunk:
            out[k] = count_long(encode, x, chunk, overlap)
    return out


def token_counts(docs: DataFrame, path: str, limit: int = 512, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = texts_of(batch.column(1))
        counts = np.array(count_tokens(texts, path, chunk, overlap), dtype=np.int64)
        n_bytes = np.array([len(x.encode("utf-8", "surrogatepass")) for x in texts], dtype=np.int64)
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n_bytes), pa.array(counts), pa.array(counts > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"]
        )

    return map_rows(docs.select("doc_id", "text"), run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
