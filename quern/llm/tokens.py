"""Tokenizer ids of whole texts, by way of a bounded memory of encoded chunks."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from quern.llm.common import remembered

#: White space beside a space or line feed, for RE2: all that the pre-tokenizer or Python counts as such.
_WHITE = r"[\t-\r\x1c-\x20\x{85}\p{Z}]"
_GAP = rf"{_WHITE}[ \n]|\n{_WHITE}|\x00"
_CUT = re.compile(r"(?<=\S)(?= )")
#: A word of Latin-1 letters, perhaps with a run of marks behind it (no apostrophe: it may begin a contraction).
_WORD = r" ?[A-Za-zÀ-ÖØ-öø-ÿ]+"
_EASY = rf"^(?P<word>{_WORD})(?P<marks>[.,;:!?*#$%&)\]\"]*)$"
#: The public byte alphabet: bytes that aren't printable are moved behind Latin-1, in order.
_SHOWN = {*range(33, 127), *range(161, 173), *range(174, 256)}
_MOVED = [b for b in range(256) if b not in _SHOWN]
_ALPHABET = np.array([b if b in _SHOWN else 256 + _MOVED.index(b) for b in range(256)], "<u2")
_ALPHABET[10] = 10  # words are put on lines


def tokenizer_path(name: str) -> str:
    """Where the installed public vocabulary ``name`` lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def load(path: str, plain_special: bool = False):
    """The tokenizer of a file; ``plain_special``: special strings in a text are ordinary text."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = plain_special
    return tokenizer


class Sequences:
    """Many id sequences in one array."""

    def __init__(self):
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0
        self.begins, self.sizes, self.count = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64), 0

    def add(self, ids: np.ndarray, sizes: np.ndarray) -> range:
        """Appends sequences of the given sizes; their numbers."""
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
        while self.count + len(sizes) > len(self.sizes):
            self.begins = np.concatenate((self.begins, np.zeros_like(self.begins)))
            self.sizes = np.concatenate((self.sizes, np.zeros_like(self.sizes)))
        new = slice(self.count, self.count + len(sizes))
        self.ids[self.used : self.used + len(ids)] = ids
        self.begins[new], self.sizes[new] = self.used + np.cumsum(sizes) - sizes, sizes
        self.used, self.count = self.used + len(ids), new.stop
        return range(new.start, new.stop)

    def take(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of sequences one after the other, and where each ends."""
        sizes = self.sizes[which]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        return self.ids[np.repeat(self.begins[which] - ends + sizes, sizes) + np.arange(total)], ends


class ChunkEncoder:
    """Ids of texts as unsigned 32-bit integers.

    A text is cut into chunks where its pre-tokenizer cuts anyway, and each distinct chunk of a
    batch is looked at once. ``spaces``: the vocabulary keeps white space (byte-level patterns,
    in which a word takes one space before it), so a chunk keeps the space before it, and a
    lone line feed is a chunk. Without, spaces and line feeds only separate (patterns that drop
    them). No token crosses from a character that isn't white space to a space, or a line feed
    between two such characters, so cutting there changes no id.

    Most chunks are a word of Latin-1 letters, perhaps with marks behind it, which the
    pre-tokenizer makes two parts of. Words, runs of marks and all other chunks are the units
    that are encoded and remembered; words go to the model as they are.

    What is remembered is bounded in bytes (``LIMIT``, in each of two generations: when the new
    one is full, it becomes the old one, and what is met again moves to the next new one), so
    that texts without spaces, whose chunks are long, take no more memory than others. Beside
    it, a batch takes a small multiple of its own bytes; but a chunk that the pre-tokenizer
    can't cut is encoded by the library at once, for which it takes some 60 bytes a character.
    """

    LIMIT = 16 << 20
    #: Longer units aren't remembered (bytes).
    LONGEST = 64
    #: Words that go to the model in one text.
    LINES = 500

    def __init__(self, path: str, spaces: bool, plain_special: bool = False):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = load(path, plain_special)
        self.model_only = Tokenizer(self.tokenizer.model)  # shared, not copied
        self.model_only.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        (self.mark,) = self.model_only.encode(".", add_special_tokens=False).ids
        self.spaces = spaces
        self.forget()

    def forget(self) -> None:
        # the k-th unit has the k-th sequence; units that aren't remembered are null
        self.known, self.store = pa.array([], pa.string()), Sequences()
        self.old, self.old_store = self.known, self.store

    def remembered_bytes(self) -> int:
        return self.known.nbytes + 4 * self.store.used + 16 * self.store.count

    def encode(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text as little-endian bytes; null is the empty text."""
        ids, ends = self.flat(texts)
        raw, cuts = ids.astype("<u4", copy=False).tobytes(), [0, *(4 * ends).tolist()]
        return [raw[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def flat(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and where each text ends."""
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        chunks = self._chunks(pc.fill_null(texts, ""))
        coded = chunks.flatten().dictionary_encode()
        ids, ends = self._encoded(coded.dictionary).take(coded.indices.to_numpy())
        offsets = chunks.offsets.to_numpy() - chunks.offsets[0].as_py()
        return ids, np.concatenate(([0], ends))[offsets[1:]]

    def _chunks(self, texts: pa.Array) -> pa.ListArray:
        if not self.spaces:
            return pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        odd = pc.match_substring_regex(texts, _GAP)
        if not pc.any(odd).as_py():
            return self._cut(texts)
        rare = pa.array([_CUT.split(x) for x in texts.filter(odd).to_pylist()], pa.list_(pa.string()))
        mixed = pa.concat_arrays([rare, self._cut(texts.filter(pc.invert(odd)))])
        odd = odd.to_numpy(zero_copy_only=False)
        order = np.where(odd, np.cumsum(odd) - 1, len(rare) + np.cumsum(~odd) - 1)
        return mixed.take(pa.array(order))

    @staticmethod
    def _cut(texts: pa.Array) -> pa.ListArray:
        marked = pc.replace_substring(pc.replace_substring(texts, " ", "\0 "), "\n", "\0\n\0")
        return pc.split_pattern(marked, "\0")

    def _encoded(self, chunks: pa.Array) -> Sequences:
        """The ids of distinct chunks, in their order."""
        parts = pc.extract_regex(chunks, _EASY)
        easy = parts.is_valid()
        words = pc.if_else(easy, pc.struct_field(parts, "word"), chunks).dictionary_encode()
        marks = pc.if_else(easy, pc.struct_field(parts, "marks"), "").dictionary_encode()
        places = self._places(pa.concat_arrays([words.dictionary, marks.dictionary]))
        both = np.empty(2 * len(chunks), np.int64)
        both[::2] = places[words.indices.to_numpy()]
        both[1::2] = places[len(words.dictionary) + marks.indices.to_numpy()]
        ids, ends = self.store.take(both)
        found = Sequences()
        found.add(ids, np.diff(ends[1::2], prepend=0))
        return found

    def _places(self, units: pa.Array) -> np.ndarray:
        """The numbers of the units in the store, where unknown ones are put."""
        if self.remembered_bytes() > self.LIMIT:
            self.old, self.old_store = self.known, self.store
            self.known, self.store = pa.array([], pa.string()), Sequences()
        places = pc.index_in(units, value_set=self.known)
        found = pc.fill_null(places, -1).to_numpy().astype(np.int64)
        for learn in (self._take_over, self._learn):
            at = np.flatnonzero(found < 0)
            if len(at):
                found[at] = learn(units.take(pa.array(at)))
        return found

    def _keep(self, units: pa.Array, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        fits = pc.less_equal(pc.binary_length(units), self.LONGEST)
        self.known = pa.concat_arrays([self.known, pc.if_else(fits, units, pa.scalar(None, pa.string()))])
        return np.array(self.store.add(ids, sizes), np.int64)

    def _take_over(self, units: pa.Array) -> np.ndarray:
        """Numbers of units that the old generation knows, else -1."""
        places = pc.index_in(units, value_set=self.old)
        again = places.is_valid()
        numbers = np.full(len(units), -1, np.int64)
        if pc.any(again).as_py():
            ids, ends = self.old_store.take(places.drop_null().to_numpy())
            numbers[again.to_numpy(zero_copy_only=False)] = self._keep(units.filter(again), ids, np.diff(ends, prepend=0))
        return numbers

    def _learn(self, units: pa.Array) -> np.ndarray:
        """Encodes new units; their numbers."""
        plain = pc.match_substring_regex(units, f"^{_WORD}$")
        numbers, easy = np.empty(len(units), np.int64), plain.to_numpy(zero_copy_only=False)
        if easy.any():
            numbers[easy] = self._keep(units.filter(plain), *self._words(units.filter(plain)))
        if not easy.all():
            hard = units.filter(pc.invert(plain))
            found = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(hard.to_pylist(), add_special_tokens=False)]
            numbers[~easy] = self._keep(hard, np.concatenate(found), np.array([len(x) for x in found]))
        return numbers

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids and sizes of words, put on lines of long texts with a mark after each: the
        pre-tokenizer's other steps leave these characters alone but for the byte alphabet and
        lower case."""
        if not self.spaces:
            words = pc.utf8_lower(words)
        cuts = pa.array([*range(0, len(words), self.LINES), len(words)], pa.int32())
        texts = pc.binary_join(pa.ListArray.from_arrays(cuts, words), "\n.\n").to_pylist()
        shown = [_ALPHABET[np.frombuffer(x.encode() + b"\n.", np.uint8)].tobytes().decode("utf-16-le") for x in texts]
        ids = np.concatenate([np.array(e.ids, np.uint32) for e in self.model_only.encode_batch_fast(shown, add_special_tokens=False)])
        at = np.flatnonzero(ids == self.mark)
        if len(at) != len(words):
            raise ValueError("the model makes the mark's id from letters")
        return ids[ids != self.mark], np.diff(at, prepend=-1) - 1


def encoder(path: str, spaces: bool, plain_special: bool = False) -> ChunkEncoder:
    """One encoder for each Python worker and vocabulary."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return remembered(("encoder", path, spaces, plain_special), lambda: ChunkEncoder(path, spaces, plain_special))
