"""Whole-text token ids.

Strings of special tokens in a text are ordinary text, as the vocabularies' own description has it. The ids of a text are those of the pieces that its pre-tokeniser cuts, in order. For the vocabulary that
drops white space pieces repeat enough that each worker keeps a bounded cache of their ids as bytes.
"""

from __future__ import annotations

import json
import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
import tiktoken
from tokenizers import Tokenizer

#: Entries of each of the two generations of a cache.
CACHE = 300_000
END_ID = 1
_SIMPLE = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\\[-`{-~]*)")


class _Cache(dict):
    """A dict that computes what it misses and, when full, keeps what was used since the last time."""

    def __init__(self, make):
        self.make, self.old = make, {}

    def __missing__(self, key):
        if len(self) >= CACHE:
            self.old = dict(self)
            self.clear()
        self[key] = value = self.old.get(key) or self.make(key)
        return value


def byte_alphabet() -> dict[int, str]:
    """The printable stand-ins that byte-level vocabularies write for bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class WordEncoder:
    """Ids by the tokenizers library for a vocabulary that drops white space."""

    def __init__(self, path: str):
        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True
        self.dtype = np.dtype("<u2" if self.whole.get_vocab_size() <= 1 << 16 else "<u4")
        self.alphabet = str.maketrans({chr(b): c for b, c in byte_alphabet().items()})
        self.runs = _Cache(self._run)
        self.pieces = _Cache(self._piece)

    def _pack(self, ids) -> bytes:
        return array("HI"[self.dtype.itemsize // 4], ids).tobytes()

    def _run(self, run: str) -> bytes:
        mapped = run.encode().decode("latin-1").translate(self.alphabet)
        return self._pack([t.id for t in self.whole.model.tokenize(mapped)])

    def _piece(self, piece: bytes) -> bytes:
        text = piece.decode()
        if m := _SIMPLE.fullmatch(text):
            # One run of letters and one of signs: two pieces of the pre-tokeniser.
            return self.runs[m[1].lower()] + (self.runs[m[2]] if m[2] else b"")
        return self._pack(self.whole.encode(text, add_special_tokens=False).ids)

    def encode(self, text: str | None) -> bytes:
        return b"".join(map(self.pieces.__getitem__, (text or "").encode().split()))


#: The pattern of the byte-level vocabulary with possessive runs: the same pieces, found without stepping back.
PIECES = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
#: The same for texts in which no two signs of white space are side by side: without lookaround an automaton finds the pieces.
SINGLE = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s"""
#: Two signs of white space, as the patterns above have it.
RUN = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]{2}"
#: The library reads texts to a buffer quickly only if there is a special token; it is never allowed, so also this string is ordinary text.
_NEVER = "\0never"


class ByteEncoder:
    """Ids of a byte-level vocabulary that keeps white space (a tokenizers file), found by rank merging.

    Ranks give the same ids if the merges are in order of their ids, which is checked; whole texts are
    faster by ranks than pieces by a cache.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        back = {c: b for b, c in byte_alphabet().items()}
        special = {t["content"] for t in spec["added_tokens"]}
        vocab = spec["model"]["vocab"]
        made = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in spec["model"]["merges"]]
        if any(a >= b for a, b in zip(made, made[1:])) or max(i for t, i in vocab.items() if len(t) == 1) > min(made, default=1 << 32):
            raise ValueError("the merges are not in order of their ids, so ranks would give other ids")
        ranks = {bytes(back[c] for c in token): i for token, i in vocab.items() if token not in special}
        made_by = lambda name, pattern: tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=ranks, special_tokens={_NEVER: max(ranks.values()) + 1})
        self.single, self.any = made_by("single", SINGLE), made_by("bytes", PIECES)
        self.dtype = np.dtype("<u2" if max(ranks.values()) < 1 << 16 else "<u4")
        # The number of a token without regard to case and the white space before it; 0 for white space alone.
        self.fold, known = np.zeros(max([*ranks.values(), END_ID]) + 1, np.int64), {b"": 0}
        for token, i in ranks.items():
            self.fold[i] = known.setdefault(token.lower().strip(), len(known))
        self.n_terms = len(known)

    def encode(self, text: str | None) -> bytes:
        return self.encode_all(pa.array([text], pa.string()))[0]

    def encode_all(self, col: pa.Array) -> list[bytes]:
        """Ids of each text; null is empty."""
        runs = pyarrow.compute.match_substring_regex(col, RUN)
        return [self._ids(self.any if run.as_py() else self.single, t.as_py()) for t, run in zip(col, runs, strict=True)]

    def _ids(self, encoding: tiktoken.Encoding, text: str | None) -> bytes:
        return encoding.encode_to_numpy(text, disallowed_special=()).astype(self.dtype).tobytes() if text else b""


@lru_cache(maxsize=4)
def encoder(path: str, kind: str):
    """One encoder for each worker process."""
    return {"word": WordEncoder, "byte": ByteEncoder}[kind](path)
