"""Token ids of texts with a tokenizer file, each distinct piece of text encoded once.

A byte-level BPE splits a text before every single space that stands between two
characters that are no white space, whatever comes before or after. So a text
without white space in a row is the chain of its space-led pieces, and each
distinct piece needs the tokenizer only once per task; new ones are encoded as one
chain, and the byte lengths of the ids tell the pieces apart. Other texts, and those
that hold the string of an added token, are encoded whole. Ids equal those of encoding the whole text.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

DEFAULT = "byte_bpe_50k.json"
_ROW_OF_SPACE = r"[\s\p{Z}\x{0B}\x{1C}-\x{1F}\x{85}\x{200B}\x{FEFF}]{2}"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(DEFAULT)


class Encoder:
    """Encodes columns of texts; ``most`` bounds the pieces kept between columns."""

    def __init__(self, path: str | None = None, most: int = 250_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path or default_path())
        added = [re.escape(t.content.strip()) for t in self.tokenizer.get_added_tokens_decoder().values()]
        #: Strings of added tokens, which the tokenizer takes out of a text before it splits the rest.
        self.added = "(?i)" + "|".join(added) if added else None
        self.most = most
        vocabulary = self.tokenizer.get_vocab()
        #: Bytes of each id: a byte-level token has one character for each.
        self.bytes_of = np.zeros(max(vocabulary.values()) + 1, np.int64)
        self.bytes_of[list(vocabulary.values())] = [len(x) for x in vocabulary]
        #: The smallest unsigned type that holds every id.
        self.type = np.uint16 if len(self.bytes_of) <= 1 << 16 else np.uint32
        self._forget()

    def _forget(self) -> None:
        self.place: dict[str, int] = {}
        self.starts = np.zeros(0, np.int64)
        self.lengths = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _chained(self, pieces: list[str], between: str) -> tuple[np.ndarray, np.ndarray]:
        """All ids of pieces encoded as one text, and the number of ids of each piece (and of what is between)."""
        chain = between.join(pieces)
        ids = np.array(self._whole([chain])[0], np.uint32)
        sizes = np.array([len(x.encode()) for x in pieces], np.int64)
        if between:
            sizes = np.stack([sizes, np.full(len(sizes), len(between))], axis=1).ravel()[:-1]
        ends = np.searchsorted(np.cumsum(self.bytes_of[ids]), np.cumsum(sizes)) + 1
        return ids, np.diff(ends, prepend=0)

    def _learn(self, ids: np.ndarray, counts: np.ndarray, pieces: list[str]) -> None:
        """Note the ids of new pieces, which lie in a row; what has no name in ``pieces`` is between them."""
        step = 1 if len(counts) == len(pieces) else 2
        starts = np.cumsum(counts) - counts + len(self.ids)
        known = len(self.starts)
        self.place.update(zip(pieces, range(known, known + len(pieces)), strict=True))
        self.starts = np.concatenate([self.starts, starts[::step]])
        self.lengths = np.concatenate([self.lengths, counts[::step]])
        self.ids = np.concatenate([self.ids, ids])

    def _places(self, pieces: list[str]) -> np.ndarray:
        led: list[str] = []
        bare: list[str] = []
        alone: list[str] = []
        for p in pieces:
            if p not in self.place:
                if len(p) < 2 or p[-1].isspace() or p[1].isspace() or (p[0].isspace() and p[0] != " "):
                    alone.append(p)
                else:
                    (led if p[0] == " " else bare).append(p)
        for new, between in ((led, ""), (bare, "\n")):
            if new:
                self._learn(*self._chained(new, between), new)
        if alone:
            found = self._whole(alone)
            self._learn(np.array([i for x in found for i in x], np.uint32), np.array([len(x) for x in found], np.int64), alone)
        return np.fromiter(map(self.place.__getitem__, pieces), np.int64, len(pieces))

    def _pieced(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        parts = pc.split_pattern(column, " ")
        bounds = parts.offsets.to_numpy() - parts.offsets[0].as_py()
        coded = parts.flatten().dictionary_encode()
        code = coded.indices.to_numpy().astype(np.int64) * 2
        code[bounds[:-1]] += 1  # the first piece of a text has no space before it
        used = np.zeros(2 * len(coded.dictionary), bool)
        used[code] = True
        kinds = np.flatnonzero(used)
        names = coded.dictionary.take(pa.array(kinds >> 1)).to_pylist()
        place_of = np.zeros(len(used), np.int64)
        place_of[kinds] = self._places([x if k & 1 else " " + x for x, k in zip(names, kinds.tolist(), strict=True)])
        place = place_of[code]
        size = self.lengths[place]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.ids[np.repeat(self.starts[place] - (ends - size), size) + np.arange(total)]
        return ids, np.concatenate([[0], ends])[bounds]

    def encode(self, column: pa.Array) -> list[np.ndarray]:
        """The ids of each text, null taken as empty."""
        if len(column) == 0:
            return []
        column = column.cast(pa.large_string()).fill_null("")
        if len(self.place) > self.most:
            self._forget()
        odd = pc.match_substring_regex(column, _ROW_OF_SPACE).to_numpy(zero_copy_only=False)
        if self.added:
            odd = odd | pc.match_substring_regex(column, self.added).to_numpy(zero_copy_only=False)
        ids, bounds = self._pieced(column if not odd.any() else pc.if_else(pa.array(odd), "", column))
        out = [ids[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        where = np.flatnonzero(odd)
        for i, found in zip(where.tolist(), self._whole(column.take(pa.array(where)).to_pylist()), strict=True):
            out[i] = np.array(found, np.uint32)
        return out


#: Bytes of text to encode together: distinct pieces are looked up once in each.
SLICE = 6 << 20


@lru_cache(maxsize=1)
def encoder(path: str | None = None) -> Encoder:
    """The encoder of this Python worker, kept from task to task."""
    return Encoder(path)
