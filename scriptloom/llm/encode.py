"""Token ids of many texts with the tokenizers library, memoised by space-separated unit.

Both byte-level pre-tokenisers used here cut before a space that a
non-white-space character follows, whatever stands before it, so a text is the
concatenation of such units and each distinct unit needs encoding once. Texts
with other white-space runs are cut where white space follows a character that
is none, which is a cut in every case. The memo is bounded.

Merging by rank of the joined bytes gives the library's ids where each token of the
vocabulary, encoded alone by the library's own model, is itself: a pair that is no
listed merge can then never be neighbours. This is verified for all tokens when a
vocabulary is loaded, as are the order of the merges (ascending ids), that nothing
else in the file could change the ids (normaliser, pre-tokeniser, added tokens of
other kinds than those known here); any doubt leaves all texts to the library. Where it holds, whole texts (byte-level vocabularies) or
words of letters (word-end vocabularies) within Latin-1, whose classes and case
are alike in all engines, are merged by rank, which is faster. All else takes the
library.
"""

from __future__ import annotations

import re
import sys
from array import array

from .tokens import tokenizer

#: Entries of the memo, and characters of a unit that may enter it.
MEMO_UNITS, MEMO_CHARS = 500_000, 48
_ODD_SPACE = re.compile(r" (?:\s|$)")
_UNIT = re.compile(r"\s*\S+|\s+")
_ENCODERS: dict[str, UnitEncoder] = {}


class UnitEncoder:
    """Encodes texts to little-endian ids of ``width`` bytes."""

    def __init__(self, path: str):
        self.tokenizer = tokenizer(path)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.code = "H" if self.width == 2 else "I"
        #: White space takes part in the ids (byte-level), or is dropped (word-end vocabularies).
        self.spaces_count = len(self.tokenizer.encode("a b", add_special_tokens=False).ids) != 2 or self.tokenizer.encode(" ", add_special_tokens=False).ids != []
        self.memo: dict[str, bytes] = {}
        self.ranks = _ranks(path, self.tokenizer)
        self.stops = {c: self.pack(self.tokenizer.encode(c, add_special_tokens=False).ids) for c in ".,"}

    def pack(self, ids: list[int]) -> bytes:
        out = array(self.code, ids)
        if sys.byteorder == "big":
            out.byteswap()
        return out.tobytes()

    def units(self, text: str) -> list[str]:
        if not self.spaces_count:
            return text.replace("\n", " ").split(" ") if text else []
        if _ODD_SPACE.search(text) or text[:1].isspace():
            return _UNIT.findall(text)
        words = text.split(" ")
        return [words[0], *[" " + w for w in words[1:]]]

    def encode(self, texts: list[str]) -> list[bytes]:
        memo = self.memo
        found: list = []
        holes: list[tuple[int, list[str], list, list[int]]] = []
        missing: set[str] = set()
        for k, text in enumerate(texts):
            if self.ranks is not None and self.spaces_count and _latin(text):
                found.append(self.ranks.encode_to_numpy(text, allowed_special="all").astype(f"<u{self.width}").tobytes())
                continue
            units = self.units(text)
            ids = list(map(memo.get, units))
            if None in ids:
                at = [i for i, x in enumerate(ids) if x is None]
                missing.update([units[i] for i in at])
                holes.append((k, units, ids, at))
                found.append(b"")
            else:
                found.append(b"".join(ids))
        if missing:
            encoded = self._words(missing) if self.ranks is not None and not self.spaces_count else {}
            new = [u for u in missing if u not in encoded]
            encoded |= {u: self.pack(e.ids) for u, e in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False), strict=True)}
            for k, units, ids, at in holes:
                for i in at:
                    ids[i] = encoded[units[i]]
                found[k] = b"".join(ids)
            room = MEMO_UNITS - len(memo)
            if room > 0:
                memo.update([x for x in encoded.items() if len(x[0]) <= MEMO_CHARS][:room])
        return found

    def _words(self, units: set[str]) -> dict[str, bytes]:
        """Ids of the units that are a word of Latin-1 letters, with one full stop or comma after it or none."""
        out = {}
        piece, pack, stops = self.ranks._encode_single_piece, self.pack, self.stops
        for u in units:
            stop = stops.get(u[-1:])
            word = u if stop is None else u[:-1]
            if word.isalpha() and _latin(word):
                ids = pack(piece(word.lower().encode() + WORD_END))
                out[u] = ids if stop is None else ids + stop
        return out


def _latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def _byte_alphabet() -> dict[str, int]:
    """Character that stands for each byte in byte-level vocabularies: printable Latin-1 is itself, the rest follow from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(rest)}


#: Stands for the end of a word; not a byte of UTF-8.
WORD_END = b"\xff"


def _plain(whole: dict, words: bool) -> bool:
    """Whether the file's steps around the model are those that the rank encoder takes over."""
    for t in whole.get("added_tokens") or []:
        if any(t.get(k) for k in ("single_word", "lstrip", "rstrip")) or (words and t.get("normalized")):
            return False
    if whole.get("truncation") or whole.get("padding"):
        return False
    normal, before = whole.get("normalizer"), whole.get("pre_tokenizer") or {}
    steps = before.get("pretokenizers", [before])
    last = steps[-1]
    if last.get("type") != "ByteLevel" or last.get("add_prefix_space") or any(s.get("type") not in ("ByteLevel", "Split") for s in steps):
        return False
    if words:  # a word of letters is lowered and stays one piece: any cutting pattern of words does that
        kinds = [s.get("type") for s in (normal or {}).get("normalizers", [normal or {}])]
        return set(kinds) <= {"NFC", "Replace", "Lowercase"} and "Lowercase" in kinds and len(steps) == 2
    return normal is None and len(steps) == 1 and last.get("use_regex", True)


def _ranks(path: str, loaded):
    """A rank-based encoder proven equal to the library's model, or None."""
    import json

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer
    from tokenizers.models import BPE

    with open(path, encoding="utf-8") as f:
        whole = json.load(f)
    model = whole["model"]
    suffix = model.get("end_of_word_suffix") or ""
    if not _plain(whole, bool(suffix)):
        return None
    if model.get("type") != "BPE" or model.get("continuing_subword_prefix") or model.get("dropout") or model.get("ignore_merges"):
        return None
    special = {t.content: i for i, t in loaded.get_added_tokens_decoder().items()}
    letters = _byte_alphabet()
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    tokens = {t: i for t, i in model["vocab"].items() if t not in special}
    made = [model["vocab"].get(a + b, -1) for a, b in merges]
    if made != sorted(set(made)) or (made and made[0] < 0):
        return None  # ids must ascend with the merges, as ranks do
    ends = {t: i for t, i in tokens.items() if suffix and t.endswith(suffix)}
    inner = {t: i for t, i in tokens.items() if t not in ends}
    for some, end in ((inner, None), (ends, suffix)):
        if some:
            alone = Tokenizer(BPE(vocab=model["vocab"], merges=merges, **({"end_of_word_suffix": end} if end else {})))
            words = [t[: len(t) - len(end or "")] for t in some]
            if any(e.ids != [i] for e, i in zip(alone.encode_batch_fast(words, add_special_tokens=False), some.values(), strict=True)):
                return None
    if any(c not in letters for t in inner for c in t):
        return None
    ranks = {bytes(letters[c] for c in t): i for t, i in inner.items()}
    ranks |= {bytes(letters[c] for c in t[: -len(suffix)]) + WORD_END: i for t, i in ends.items()}
    if len(ranks) != len(tokens) or any(bytes([b]) not in ranks for b in range(256)):
        return None
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


def encoder(path: str) -> UnitEncoder:
    """One encoder per worker and vocabulary."""
    if path not in _ENCODERS:
        _ENCODERS[path] = UnitEncoder(path)
    return _ENCODERS[path]
