"""Loading public tokenizer files and cutting texts where a tokenizer's own rules always cut.

A tokenizer that drops white space encodes the pieces between white space on their
own, so a text is the sum of its pieces, and pieces repeat: each worker keeps a
bounded cache of piece results. This holds for texts of plain characters (``PLAIN``);
any other text goes through the tokenizer whole.
"""

from __future__ import annotations

import os
import re

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: ASCII without control characters, and the Latin-1 letters: white space, case and
#: composition are the same for Python and for the tokenizers library here.
PLAIN = re.compile("[\t\n\x0b\x0c\r\x20-\x7eÀ-ÖØ-öø-ÿ]*")
#: Entries of a worker's cache, and the longest piece kept.
CACHE_ENTRIES = 400_000
CACHE_LENGTH = 48

#: Batches of at most this many rows and bytes go to Python, so long texts and sets don't pile up.
ARROW_ROWS, ARROW_BYTES = "512", "4m"

_WORKER: dict = {}


def worker_value(key, make):
    """A value kept for the life of the Python worker."""
    if key not in _WORKER:
        _WORKER[key] = make()
    return _WORKER[key]


def small_batches(spark) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)


def library_tokenizer(path: str):
    """The tokenizers library's own object for a file; truncation and padding off, kept by the worker."""

    def make():
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.no_truncation()
        tok.no_padding()
        return tok

    return worker_value(("library", path), make)


def byte_symbols() -> list[str]:
    """The visible character that byte-level vocabularies use for each byte: printable bytes stand for themselves, the others get 256, 257, ... in order."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(shown) else chr(next(rest)) for b in range(256)]


class PieceCache(dict):
    """piece -> result of ``encode(piece)``, in two generations: when the younger is full it becomes the older, whose pieces come back as they are met.

    So the pieces in use stay, and at most ``limit`` results are held beside ``frequent``.
    """

    def __init__(self, encode, frequent: dict | None = None, limit: int = CACHE_ENTRIES, longest: int = CACHE_LENGTH):
        super().__init__(frequent or {})
        self.encode, self.frequent, self.longest = encode, frequent or {}, longest
        self.young, self.older = len(self.frequent) + limit // 2, {}

    def __missing__(self, piece):
        value = self.older.pop(piece, None)
        if value is None:
            value = self.encode(piece)
        if len(piece) <= self.longest:
            if len(self) >= self.young:
                self.older = dict(self)
                self.clear()
                self.update(self.frequent)
            self[piece] = value
        return value
