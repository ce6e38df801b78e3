"""Token ids of texts as the tokenizers library gives them, with shared work cached.

A byte-level BPE never merges across pre-tokens, and the pre-tokenizer of these
vocabularies looks at most one character ahead. A text in which no two white-space
characters are adjacent and none stands at an end therefore splits at its single spaces
and newlines into units whose ids depend on the unit alone; a comma or full stop that
follows a letter or digit and ends its unit is a unit of its own. Units repeat, so their
ids are kept in a bounded table; a new unit is encoded from the same vocabulary's rank
file. Every other text (adjacent white space, a special token's string, rare scripts)
goes through the library whole.
"""

from __future__ import annotations

import base64
import functools
import os
import re
from array import array

import numpy as np

DOUBLE = re.compile(r"\s\s")
#: Outside these ranges Unicode versions may differ between libraries on what a letter is.
RARE = re.compile("[^\x01-ɏ‐-‧€]")
AFTER_OTHER = re.compile(r"[\W_][,.] ")
MAX_UNITS = 300_000


def default_vocabulary() -> str:
    """The path of the default vocabulary file, on whichever machine this runs."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class _Units(dict):
    """Unit -> ids, in two generations: the older one goes when the newer one is full."""

    def __init__(self, encode, most: int | None = None):
        self.encode, self.most, self.older = encode, most, {}

    def __missing__(self, unit: str) -> bytes:
        got = self.older.get(unit)
        if got is None:
            mark = unit[:1]
            asked = unit if mark == "\n" else unit[1:] if mark == "\x00" else f" {unit}"
            got = array("I", self.encode(asked)).tobytes()
        if len(self) >= (self.most or MAX_UNITS):
            self.older = dict(self)
            self.clear()
        self[unit] = got
        return got


class TokenIds:
    """ids(text) as little-endian uint32 bytes, by the library's defaults, no special ids added.

    ``path`` is a tokenizers JSON file. Where the rank file of the same vocabulary stands
    beside it, new units are encoded from that, which is faster; else by the library.
    """

    def __init__(self, path: str | None = None, max_units: int | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        path = path or default_vocabulary()
        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.units = _Units(self._unit_encoder(path.removesuffix(".json") + ".tiktoken"), max_units)

    def _unit_encoder(self, ranks_path: str):
        if not os.path.exists(ranks_path):
            return lambda s: self.library.encode(s, add_special_tokens=False).ids
        import public_tokenizers
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        return tiktoken.Encoding(
            "units", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        ).encode_ordinary

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        if (
            text[0].isspace()
            or text[-1].isspace()
            or RARE.search(text)
            or DOUBLE.search(text)
            or any(s in text for s in self.special)
        ):
            return self.whole(text)
        spaced = text.replace("\n", " \n")
        if not AFTER_OTHER.search(spaced):
            spaced = spaced.replace(", ", " \x00, ").replace(". ", " \x00. ")
        first, *rest = spaced.split(" ")
        return self.whole(first) + b"".join(map(self.units.__getitem__, rest))


@functools.lru_cache(maxsize=1)
def worker_token_ids(path: str | None, max_units: int | None = None) -> TokenIds:
    """One per worker process: its tables are read once, and its units serve the tasks that follow."""
    return TokenIds(path, max_units)
