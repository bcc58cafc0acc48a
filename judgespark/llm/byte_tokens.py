"""Token ids of whole texts by a byte-level tokenizer file.

Where the file numbers its tokens by the order of their merges, as ranks, plain texts go to an encoder of such ranks
made from it, which gives the same ids several times faster. A text with anything beyond Latin letters and
common punctuation, or with what may be a special token, is cut before every space or line end that
follows other than white space, where the tokenizer cuts too whatever comes next; its stretches go
to one or the other.
"""

from __future__ import annotations

import json
import re
from pathlib import Path

import numpy as np

# Characters beyond those that every table of letters, digits and white space agrees on, and special tokens.
_OTHER = re.compile("[\x1c-\x1f\x7f-\u0084\u0086-\u009f\u0250-\u200f\u2028-\U0010ffff]|<\\|")
_CUT = re.compile(r"(?<=\S)(?=[ \n])")
# Fixed: how byte-level tokenizers cut texts.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _bytes_of_letters() -> dict[str, int]:
    """Printable bytes are written as themselves, the others as letters from 256 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256, 512))
    return {chr(b) if b in own else chr(next(others)): b for b in range(256)}


def _ranks(path: str) -> dict[bytes, int] | None:
    """Ids by token, or None if they do not follow the merges."""
    model = json.loads(Path(path).read_text())["model"]
    ids, letters = model["vocab"], _bytes_of_letters()
    pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
    if any(ids["".join(pair)] != 256 + i for i, pair in enumerate(pairs)) or len(ids) != 256 + len(model["merges"]):
        return None
    return {bytes(letters[c] for c in token): i for token, i in ids.items()}


class Encoder:
    """Calls give the ids of a text and then ``end``, as 32-bit numbers."""

    _open: dict[tuple[str, int], Encoder] = {}

    @classmethod
    def of(cls, path: str, end: int) -> Encoder:
        """One for each worker process."""
        if (path, end) not in cls._open:
            cls._open[path, end] = cls(path, end)
        return cls._open[path, end]

    def __init__(self, path: str, end: int):
        import tiktoken
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._end = [end]
        ranks = _ranks(path)
        own = ranks and tiktoken.Encoding(path, pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._by_rank = own.encode_ordinary if own else self._whole

    def _whole(self, text: str) -> list[int]:
        return self._tokenizer.encode(text, add_special_tokens=False).ids

    def __call__(self, text: str) -> np.ndarray:
        if not _OTHER.search(text):
            return np.array(self._by_rank(text) + self._end, np.uint32)
        ids = []
        for stretch in _CUT.split(text):
            ids += self._whole(stretch) if _OTHER.search(stretch) else self._by_rank(stretch)
        return np.array(ids + self._end, np.uint32)
