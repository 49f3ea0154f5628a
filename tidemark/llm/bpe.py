"""BPE as a streaming transducer with bounded lookahead, and an incremental decoder.

Lookahead. Compare the runs of the merge list over two texts with a common prefix w.
Left of some border the two segmentations agree; at first the border is the end of w.
Working through the merges by rank, the border moves left only when a merge (a, b)
joins the token a just left of the border with a token b that starts at it; it then
moves by the length of a, and the token at the border starts with a from then on. So
the next move, by a merge (c, d) of a higher rank, needs a on the left spine of d (d,
its left part, that one's left part, ...). The longest chain of such moves bounds how
far back unseen text can reach:

    reach(a, b) = |a| + max(0, reach of earlier merges (x, y) with x on b's left spine)

and ``lookahead`` is the largest reach. Tokens that end at least that far before the
end of the text seen so far are final; and as no merge crosses a final boundary, the
text after it can be encoded on its own. The transducer therefore holds lookahead +
step symbols, whatever the length of a word. It needs a proper merge list (parts made
before they are used), which is checked.

Defined cases: a null text is empty; empty and white-space texts have no tokens; special
strings inside a text become their ids, as the library's default does.
"""

from __future__ import annotations

import codecs
import heapq
import json
import re
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import regex

from tidemark.llm import vocab

STEP = 256
#: Symbols of a long word taken at once, bytes of a word fed at once, and characters of a text encoded before their ids go on.
LONG_STEP, FEED, SEGMENT = 4096, 16384, 65536


class BpeModel:
    """Merges and vocabulary of a byte-level BPE file, with its lookahead."""

    def __init__(self, spec: dict):
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.token: dict[int, str] = {i: t for t, i in self.vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.token |= {i: t for t, i in self.special.items()}
        #: pair of ids -> (rank, id of the merged token)
        self.merge = {(self.vocab[a], self.vocab[b]): (rank, self.vocab[a + b]) for rank, (a, b) in enumerate(merges)}
        self.byte = [self.vocab[s] for s in vocab.byte_symbols()]
        self.last_byte = [self.vocab[s + self.suffix] for s in vocab.byte_symbols()] if self.suffix else self.byte
        self.lookahead = self._lookahead()

    def _lookahead(self) -> int:
        left: dict[int, int] = {}
        size: dict[int, int] = dict.fromkeys([*self.byte, *self.last_byte], 1)
        reach: dict[int, int] = {}
        longest = 0
        for (a, b), (_, made) in self.merge.items():
            if a not in size or b not in size:
                raise ValueError("a merge uses a token that no earlier merge makes")
            best, t = 0, b
            while t is not None:
                best, t = max(best, reach.get(t, 0)), left.get(t)
            now = size[a] + best
            reach[a] = max(reach.get(a, 0), now)
            longest = max(longest, now)
            if made not in size:
                left[made], size[made] = a, size[a] + size[b]
        self.size = size
        return longest

    def symbols(self, word: bytes, last: bool) -> list[int]:
        """The ids a run of bytes starts from; ``last`` if the word ends with it."""
        table = self.byte
        ids = [table[b] for b in word]
        if last and ids:
            ids[-1] = self.last_byte[word[-1]]
        return ids

    def merge_all(self, ids: list[int]) -> list[int]:
        """All merges by rank, the leftmost of equals first."""
        if len(ids) > 64:
            return self._merge_long(ids)
        merge, none = self.merge, (1 << 60, 0)
        pairs = [merge.get(p, none) for p in zip(ids, ids[1:], strict=False)]
        while pairs:
            best = min(pairs)
            if best is none or best[0] == none[0]:
                break
            i = pairs.index(best)
            ids[i : i + 2] = [best[1]]
            del pairs[i]
            if i:
                pairs[i - 1] = merge.get((ids[i - 1], ids[i]), none)
            if i < len(pairs):
                pairs[i] = merge.get((ids[i], ids[i + 1]), none)
        return ids


    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same for long runs: a heap of pairs over a linked list, so time grows with n log n."""
        merge, n = self.merge, len(ids)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(m[0], i, ids[i], ids[i + 1], m[1]) for i in range(n - 1) if (m := merge.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, made = heapq.heappop(heap)
            j = after[i]
            # an entry counts only while its two tokens still stand there
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = made, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if m := merge.get((made, ids[k])):
                    heapq.heappush(heap, (m[0], i, made, ids[k], m[1]))
            h = before[i]
            if h >= 0 and (m := merge.get((ids[h], made))):
                heapq.heappush(heap, (m[0], h, ids[h], made, m[1]))
        return [t for t in ids if t >= 0]


class Transducer:
    """Takes a word's bytes piece by piece and gives its token ids as soon as they are final."""

    def __init__(self, model: BpeModel, step: int = STEP):
        self.model, self.step, self.held = model, step, []

    def stream(self, data: bytes) -> Iterator[list[int]]:
        """Ids of a long word in parts, each as soon as it is final."""
        self.step, was = LONG_STEP, self.step
        for i in range(0, len(data) - FEED, FEED):
            yield self.feed(data[i : i + FEED])
        i = max(0, -(-(len(data) - FEED) // FEED) * FEED)
        yield self.finish(data[i:])
        self.step = was

    def feed(self, data: bytes) -> list[int]:
        """Bytes that don't end the word."""
        out, model = [], self.model
        for i in range(0, len(data), self.step):
            self.held += model.symbols(data[i : i + self.step], False)
            while len(self.held) >= model.lookahead + self.step:
                final, end = len(self.held) - model.lookahead, 0
                ids = model.merge_all(self.held[:])
                for k, t in enumerate(ids):
                    if end + model.size[t] > final:
                        break
                    end += model.size[t]
                else:
                    k = len(ids)
                if not end:
                    break
                out += ids[:k]
                self.held = self.held[end:]
        return out

    def finish(self, data: bytes) -> list[int]:
        """The word's last bytes, at least one."""
        out = self.feed(data[:-1])
        held, self.held = self.held + self.model.symbols(data[-1:], True), []
        return out + self.model.merge_all(held)

    def word(self, data: bytes) -> list[int]:
        if len(data) <= self.step:
            return self.model.merge_all(self.model.symbols(data, True))
        return self.finish(data)


class Encoder:
    """Texts to ids for a tokenizer file of white-space-dropping byte-level BPE."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        if split["type"] != "Split" or split["behavior"] != "Removed" or not split["invert"]:
            raise ValueError("only pre-tokenizers that keep a pattern's matches are supported")
        self.model = BpeModel(spec)
        self.pattern = regex.compile(split["pattern"]["Regex"])
        self.special = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.model.special, key=len, reverse=True)) + ")") if self.model.special else None
        self.normalizer = vocab.library_tokenizer(path).normalizer
        self.transducer = Transducer(self.model)
        self.pieces = vocab.PieceCache(self._piece)

    def _words(self, text: str) -> Iterator[list[int]]:
        """Ids of a text without special strings, a word or a part of a long one at a time."""
        for word in self.pattern.finditer(text):
            data = word[0].encode("utf-8")
            if len(data) > FEED:
                yield from self.transducer.stream(data)
            else:
                yield self.transducer.word(data)

    def _parts(self, text: str, normalize) -> Iterator[list[int]]:
        if self.special is None or not any(s in text for s in self.model.special):
            yield from self._words(normalize(text))
            return
        for k, part in enumerate(self.special.split(text)):
            if k % 2:
                yield [self.model.special[part]]
            elif part:
                yield from self._words(normalize(part))

    def _piece(self, piece: str) -> bytes:
        if len(piece) > STEP or (self.special is not None and any(s in piece for s in self.model.special)):
            return b"".join(np.array(ids, "<u4").tobytes() for ids in self._parts(piece, str.lower))
        # short pieces come by the million: no generators here
        ids, model = [], self.model
        for word in self.pattern.findall(piece.lower()):
            ids += model.merge_all(model.symbols(word.encode(), True))
        return struct.pack(f"<{len(ids)}I", *ids)

    def stream(self, text: str | None) -> Iterator[bytes]:
        """The text's ids as little-endian uint32, part by part as they are final."""
        if not text:
            return
        plain = vocab.PLAIN.fullmatch(text)
        for part in _segments(text):
            if plain:
                if len(part) <= 2 * SEGMENT:
                    yield b"".join(map(self.pieces.__getitem__, part.split()))
                else:
                    # no cut was found: some word is very long
                    yield from self._long(part, str.lower)
            else:
                yield from self._long(part, self.normalizer.normalize_str)

    def _long(self, part: str, normalize) -> Iterator[bytes]:
        held: list[int] = []
        for ids in self._parts(part, normalize):
            held += ids
            if len(held) >= SEGMENT // 4:
                yield np.array(held, "<u4").tobytes()
                held = []
        yield np.array(held, "<u4").tobytes()

    def encode_bytes(self, text: str | None) -> bytes:
        """The text's ids as little-endian uint32."""
        return b"".join(self.stream(text))


def _segments(text: str, size: int = SEGMENT) -> Iterator[str]:
    """Parts of about ``size`` characters, cut at a blank between two ASCII letters or digits, where no rule looks across."""
    at = 0
    while len(text) - at > size:
        cut = _CUT.search(text, at + size)
        if not cut:
            break
        yield text[at : cut.start() + 1]
        at = cut.end() - 1
    yield text[at:] if at else text


_CUT = re.compile(r"[A-Za-z0-9] [A-Za-z0-9]")


class Decoder:
    """Ids to text, piece by piece.

    With ``spec_decoder`` None the tokens themselves are joined by blanks, as the library
    does for files without a decoder; the state is whether anything came before. With
    "ByteLevel" symbols turn into bytes and an incremental UTF-8 decoder holds the bytes
    of an unfinished character (invalid ones become U+FFFD).
    """

    def __init__(self, model: BpeModel, spec_decoder: str | None = None):
        self.kind, self.begun = spec_decoder, False
        if spec_decoder is None:
            self.table = [model.token.get(i, "").encode("utf-8") for i in range(max(model.token) + 1)]
        else:
            back = {s: bytes([b]) for b, s in enumerate(vocab.byte_symbols())}
            self.table = [b"".join(back.get(c, c.encode("utf-8")) for c in model.token.get(i, "")) for i in range(max(model.token) + 1)]
            self.utf8 = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> bytes:
        """UTF-8 bytes of the text that these ids complete."""
        parts = map(self.table.__getitem__, ids)
        if self.kind is not None:
            return self.utf8.decode(b"".join(parts)).encode("utf-8")
        out = b" ".join(parts)
        if out or ids:
            out, self.begun = (b" " + out if self.begun else out), True
        return out

    def finish(self) -> bytes:
        self.begun = False
        return self.utf8.decode(b"", True).encode("utf-8") if self.kind is not None else b""
