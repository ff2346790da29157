"""Token ids of whole texts by the ``tokenizers`` library, with a bounded memory of pieces.

A boundary between a character that is no white space and a space is always a
boundary of the byte-level pre-tokenizer, so a text is cut there and the ids of
a piece don't depend on its neighbours. Pieces of plain Latin characters are
split as the pre-tokenizer does and go to the library's BPE model, once for
each word while it is remembered; every other piece, and every text that holds
an added token, goes through ``Tokenizer.encode`` as it is.

``ids`` takes one text; ``many`` takes a column of them and looks up each
different word of a chunk once, so a word costs Python nothing where it is
repeated.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_L = "A-Za-zÀ-ÖØ-öø-ÿŒœ"
_LETTERS = re.compile(f"[{_L}]++")
_SIMPLE = re.compile(f"[\t\n\r -~{_L}]*+")
_PRE = re.compile(rf" ?[{_L}]++| ?[0-9]++|'(?:s|t|re|ve|m|ll|d)| ?[^\s{_L}0-9]++|\s+(?!\S)|\s++")
_CUT = re.compile(r"(?<=\S)(?= )")
#: White space (and what Python takes for it) before a space: the rare texts that need care.
_SPACES = [chr(c) + " " for c in range(0x3001) if chr(c).isspace()]
_ASCII_SPACES = [s for s in _SPACES if s.isascii()]
#: Marks that form one pre-token after a word.
_MARKS = ".,!?;:*$%&#@()-"
#: Bytes of text that ``many`` takes at once (a longer text is a chunk by itself).
CHUNK = 4 << 20


def _byte_chars() -> dict[int, str]:
    """The printable character that stands for each byte in the vocabulary."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table, more = {b: chr(b) for b in keep}, 0
    for b in range(256):
        if b not in table:
            table[b] = chr(256 + more)
            more += 1
    return table


class Memory(dict):
    """Ids of pieces, in two generations of ``most`` each; find(piece) gives the ids and whether they are remembered.

    When the newer one is full it becomes the older one, which was forgotten;
    a piece that comes again is taken over.
    """

    def __init__(self, find, most: int):
        self.find, self.most, self.older = find, most, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            ids, keep = self.find(piece)
            if not keep:
                return ids
        self.put(piece, ids)
        return ids

    def put(self, piece: str, ids: bytes) -> None:
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[piece] = ids


class Encoder:
    """ids(text): unsigned 32-bit little-endian ids as bytes. pieces: how many a generation of each of the two memories holds at most."""

    def __init__(self, path: str, pieces: int = 250_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.tokenize = self.whole.model.tokenize
        self.added = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.table = _byte_chars()
        # What stands after a space up to the next one; and pre-tokens that have no space before them.
        self.words, self.parts = Memory(self._word, pieces), Memory(lambda p: (self._bpe(p), len(p) <= 40), pieces // 2)

    def _bpe(self, piece: str) -> bytes:
        if piece.isascii() and piece.isprintable():
            seen = piece.replace(" ", "Ġ")
        else:
            seen = piece.encode().decode("latin-1").translate(self.table)
        return array("I", [t.id for t in self.tokenize(seen)]).tobytes()

    def _whole(self, text: str) -> bytes:
        return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()

    def _plain(self, text: str) -> bytes:
        words, parts = self.words, self.parts
        return b"".join([words[p[1:]] if p[0] == " " and p[1:2].isalpha() else parts[p] for p in _PRE.findall(text)])

    def _word(self, word: str) -> tuple[bytes, bool]:
        if _LETTERS.fullmatch(word):
            return self._bpe(" " + word), len(word) <= 40
        core = word.rstrip(_MARKS)
        if _LETTERS.fullmatch(core):
            return self.words[core] + self.parts[word[len(core) :]], len(word) <= 8
        return self._piece(" " + word), len(word) <= 8

    def _piece(self, piece: str) -> bytes:
        return self._plain(piece) if _SIMPLE.fullmatch(piece) else self._whole(piece)

    def ids(self, text: str) -> bytes:
        if any(a in text for a in self.added):
            return self._whole(text)
        if any(c in text for c in (_ASCII_SPACES if text.isascii() else _SPACES)):
            return b"".join(map(self._piece, _CUT.split(text)))
        first, *rest = text.split(" ")
        words = self.words
        return self._piece(first) + b"".join([words[w] for w in rest])

    def many(self, texts: pa.Array) -> Iterator[bytes | memoryview]:
        """ids(text) of each text in turn; a null is empty."""
        texts = pc.fill_null(texts, "")
        ends = np.cumsum(pc.binary_length(texts).to_numpy().astype("i8"))
        at = 0
        while at < len(texts):
            upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHUNK, side="right")))
            yield from self._chunk(texts.slice(at, upto - at))
            at = upto

    def _chunk(self, texts: pa.Array) -> Iterator[bytes | memoryview]:
        added = np.zeros(len(texts), bool)
        for a in self.added:
            added |= pc.match_substring(texts, a).to_numpy(zero_copy_only=False)
        words = _Words(texts)
        easy = ~(added | words.care)
        if easy.all():
            rest = self._columns(words)
            del words
            yield from rest
            return
        # As in ids(): texts with an added token, or white space before a space.
        rest = self._columns(_Words(texts.filter(pa.array(easy)))) if easy.any() else iter(())
        for i, plain in enumerate(easy.tolist()):
            yield next(rest) if plain else self.ids(texts[i].as_py())

    def _columns(self, words: _Words) -> Iterator[memoryview]:
        """ids() of texts without added tokens and without white space before a space."""
        raw = self._table(words).take(pa.array(words.index))
        cuts = np.frombuffer(raw.buffers()[1], "i8", len(raw) + 1)[words.starts].tolist()
        data = memoryview(raw.buffers()[2] or b"")
        del words, raw
        # The pool would keep what a chunk took for good.
        pa.default_memory_pool().release_unused()
        for a, b in zip(cuts, cuts[1:]):
            yield data[a:b]

    def _table(self, words: _Words) -> pa.Array:
        """Ids by the numbers of words.index: words of letters, others, and what begins and ends a text."""
        others = [self.words[w] if ok else b"" for w, ok in zip(words.others, words.after_space)]
        edges = [*map(self._piece, words.first), *(self._piece(" " + w) for w in words.last)]
        return pa.concat_arrays([self._letters(words), pa.array(others + edges, pa.large_binary())])

    def _letters(self, words: _Words) -> pa.Array:
        """Ids of the words of letters, which may end with one mark."""
        memory = self.words
        got = list(map(memory.get, words.cores))
        for i in [i for i, ids in enumerate(got) if ids is None]:
            core = words.cores[i]
            ids = memory.older.get(core) or self._bpe(" " + core)
            if len(core) <= 40:
                memory.put(core, ids)
            got[i] = ids
        cores = pa.array(got, pa.large_binary()).take(words.core)
        marks = pa.array([b"", *(self.parts[m] for m in _MARKS)], pa.large_binary()).take(words.mark)
        return pc.binary_join_element_wise(cores, marks, pa.scalar(b"", pa.large_binary()))


class _Words:
    """The different words of a chunk of texts, which are cut at each space.

    starts: the first place of each text among all words, and the end; index: what stands at each place, as a number that counts
    the words of letters (which may end with one mark), then the others, the first of each text, and the entries of last.
    cores: different words of letters; core, mark: which of them each word of letters is, and its mark. others: the other words;
    after_space: whether they are words indeed, not white space at their end or nothing. first: what each text has before its
    first space; last: what ends a text after its last space, where that is white space or nothing.
    care: the texts with white space before a space.
    """

    _MARK = np.zeros(256, "i4")
    _MARK[list(_MARKS.encode())] = np.arange(1, len(_MARKS) + 1)

    def __init__(self, texts: pa.Array):
        parts = pc.split_pattern(texts, " ")
        self.starts = parts.offsets.to_numpy().astype("i8")
        self.first = parts.values.take(pa.array(self.starts[:-1])).to_pylist()
        coded = parts.values.dictionary_encode()
        index, words = coded.indices.to_numpy(), coded.dictionary.cast(pa.large_string())
        place = self._sort(words)
        # White space, or nothing, at the end of a word: only the last of a text may have it, or a first that is empty.
        spaces = np.append(np.zeros(len(self.core), bool), ~np.array(self.after_space, bool))[place]
        at = np.flatnonzero(spaces[index])
        text = np.searchsorted(self.starts, at, side="right") - 1
        is_first, is_last = at == self.starts[text], at == self.starts[text + 1] - 1
        empty = np.array([w == "" for w in self.first], bool)[text]
        self.care = np.zeros(len(texts), bool)
        self.care[text[~is_last & ~(is_first & empty)]] = True
        last = at[is_last & ~is_first]
        self.last = parts.values.take(pa.array(last)).to_pylist()
        self.index = place[index]
        self.index[self.starts[:-1]] = np.arange(len(words), len(words) + len(texts))
        self.index[last] = np.arange(len(words) + len(texts), len(words) + len(texts) + len(last))

    def _sort(self, words: pa.Array) -> np.ndarray:
        """Sets cores, core, mark, others and after_space; gives the number of each word."""
        core = pc.ascii_rtrim(words, characters=_MARKS)
        cut = pc.binary_length(words).to_numpy() - pc.binary_length(core).to_numpy()
        letters = pc.ascii_is_alpha(core).to_numpy(zero_copy_only=False)
        other = np.flatnonzero(~letters)
        letters[other] = pc.match_substring_regex(core.take(pa.array(other)), f"^[{_L}]+$").to_numpy(zero_copy_only=False)
        letters &= cut <= 1
        which, rest = np.flatnonzero(letters), np.flatnonzero(~letters)
        kept = core.take(pa.array(which)).dictionary_encode()
        self.cores, self.core = kept.dictionary.to_numpy(zero_copy_only=False).tolist(), kept.indices
        ends = np.frombuffer(words.buffers()[1], "i8", len(words) + 1)[1:]
        marked, mark = cut[which] == 1, np.zeros(len(which), "i4")
        mark[marked] = self._MARK[np.frombuffer(words.buffers()[2] or b"", "u1")[ends[which[marked]] - 1]]
        self.mark = pa.array(mark)
        self.others = words.take(pa.array(rest)).to_numpy(zero_copy_only=False).tolist()
        self.after_space = [w != "" and not w[-1].isspace() for w in self.others]
        place = np.empty(len(words), "i4")
        place[which], place[rest] = np.arange(len(which)), np.arange(len(which), len(words))
        return place


_held: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This process's encoder for a vocabulary file; its memory lasts over the tasks of a worker."""
    if path not in _held:
        _held[path] = Encoder(path)
    return _held[path]


def default_path() -> str:
    """The vocabulary that the registered queries use."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
