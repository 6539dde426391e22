"""BPE encoding and decoding by a traversal of a trie of distinct words."""

from __future__ import annotations

import gc
import hashlib
import json
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from graphloom.llm.common import table

_INF = float("inf")


def byte_alphabet() -> list[str]:
    """The visible character that stands for each byte in a byte-level vocabulary: itself where printable, else the next free one from 256."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(free)) for b in range(256)]


class WordBpe:
    """A vocabulary of the form of a tokenizers file with word ends: ids of words, words of ids.

    encode_words() puts distinct words into a trie and walks it depth first. The state of a node is the last
    token of its prefix's encoding: the one vocabulary entry that ends there and that the token before it does
    not merge into. A prefix's state holds for all words below it, so shared prefixes are encoded once."""

    #: ways by suffixes that are kept from one call to the next
    MOST_FAR = 200_000

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        model = whole["model"]
        self.suffix: str = model["end_of_word_suffix"]
        self.vocab: dict[str, int] = model["vocab"]
        self.special: dict[str, int] = {t["content"]: t["id"] for t in whole["added_tokens"]}
        self.tokens: dict[int, str] = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.ranks: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int, int]] = {}
        for rank, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ") for m in model["merges"]):
            left, right = self.vocab[a], self.vocab[b]
            self.ranks[left, right] = rank
            self.halves.setdefault(self.vocab[a + b], (left, right, rank))
        self._goto: list[dict[str, int]] = []
        self._words: dict[str, list[int]] = {}
        self.most_words = 250_000  # how many words' ids are kept from one call to the next
        self._meets: dict[int, bool] = {}
        self._bytes = "".join(byte_alphabet())  # a table of all 256: translate() looks nothing up in vain
        self._pieces = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{L}\p{N}]+")
        self._specials = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")")
        self._odd_space = regex.compile("[\x1c-\x1f]")
        self._space = regex.compile(r"\p{White_Space}+")

    def _automaton(self) -> None:
        """A suffix automaton over all entries: at each place of a word, the entries that end there, longest first.

        A word's last symbol is another one than the same character inside, so it has its own code point.
        _goto: by state, symbol to state; _fail: the state of the longest proper suffix; _longest: the longest entry that
        a state ends with (-1: none); _shorter: the next entry by length that an entry ends with. What is found by way of
        suffixes is kept in _far, by state too, up to MOST_FAR in all."""
        where, chars, parent = {}, [""], [0]
        self._goto.append({})
        for entry, token in self.vocab.items():
            core = entry.removesuffix(self.suffix)
            spelt = core[:-1] + self.closed(core[-1]) if core and core != entry else entry
            state = 0
            for c in spelt:
                to = self._goto[state].get(c)
                if to is None:
                    to = self._goto[state][c] = len(chars)
                    self._goto.append({})
                    chars.append(c)
                    parent.append(state)
                state = to
            where[state] = token, len(spelt)
        n = len(chars)
        depth = [0] * n
        for state in range(1, n):  # a parent's number is the smaller one
            depth[state] = depth[parent[state]] + 1
        most = max(self.tokens) + 1
        self._fail, self._longest, self._shorter, self._length = [0] * n, [-1] * n, [-1] * most, [0] * most
        for state in sorted(range(1, n), key=depth.__getitem__):
            up = parent[state]
            if up:
                self._fail[state] = self._step(self._fail[up], chars[state])
            below = self._longest[self._fail[state]]
            if state in where:
                token, size = where[state]
                self._longest[state], self._shorter[token], self._length[token] = token, below, size
            else:
                self._longest[state] = below
        leaf: dict[str, int] = {}
        self._goto = [d or leaf for d in self._goto]
        self._far: dict[int, int] = {}

    @staticmethod
    def closed(c: str) -> str:
        """The symbol of a character that ends a word."""
        return chr(ord(c) + 0x1000)

    def _step(self, state: int, c: str) -> int:
        goto, fail = self._goto, self._fail
        to = goto[state].get(c)
        while to is None and state:
            state = fail[state]
            to = goto[state].get(c)
        return to or 0

    # -- words of a text

    def chunks(self, text: str) -> list[str]:
        """The runs without white space; no piece crosses white space, so a chunk's ids stand for themselves."""
        if self._odd_space.search(text):  # str.split() would split at these too
            return [c for c in self._space.split(text) if c]
        return text.split()

    def pieces(self, chunk: str) -> list[str | int]:
        """A chunk's pieces: words in the byte alphabet, and ids of special tokens."""
        out: list[str | int] = []
        core = chunk if chunk[-1] not in ".,!" else chunk[:-1]
        if core.isascii() and core.isalpha() or core.isalpha() and "Σ" not in core and unicodedata.is_normalized("NFC", core):
            word = core.lower()  # letters alone, or with one stop
            if word.isascii() or word.isalpha():
                word = word if word.isascii() else word.encode().decode("latin-1").translate(self._bytes)
                return [word] if core is chunk else [word, chunk[-1]]
        for part in self._specials.split(chunk) if "<|" in chunk else (chunk,):
            if part in self.special:
                out.append(self.special[part])
            elif part:
                if part.isascii() and part.isprintable():  # each byte is its own character
                    out += self._pieces.findall(part.lower())
                else:
                    plain = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
                    out += [p.encode().decode("latin-1").translate(self._bytes) for p in self._pieces.findall(plain)]
        return out

    # -- ids of words

    def _spine(self, token: int, side: int) -> list[tuple[int, float]]:
        """The tokens that stand at one edge of token as it is built, each with the rank of the merge that ends it; from the whole down."""
        out, until = [], _INF
        while True:
            out.append((token, until))
            if token not in self.halves:
                return out
            until, token = self.halves[token][2], self.halves[token][side]

    def stays(self, left: int, right: int) -> bool:
        """Whether no merge crosses the border between two tokens while they are built."""
        known = self._meets.get(left << 32 | right)
        if known is None:
            if len(self._meets) > 400_000:
                self._meets.clear()
            a, b = self._spine(left, 1), self._spine(right, 0)
            i, j, known = len(a) - 1, len(b) - 1, True
            while True:
                (x, x_end), (y, y_end) = a[i], b[j]
                rank = self.ranks.get((x, y), _INF)
                # of equal ranks the leftmost goes first: inside the left token before, inside the right one after
                if rank < x_end and rank <= y_end and rank < _INF:
                    known = False
                    break
                if i == 0 and j == 0:
                    break
                if x_end <= y_end:
                    i -= 1
                else:
                    j -= 1
            self._meets[left << 32 | right] = known
        return known

    def _merged(self, word: str) -> list[int]:
        """Plain merging, for a word that a vocabulary's unreachable entries hide from the trie."""
        ids = [self.vocab[c + self.suffix * (i == len(word) - 1)] for i, c in enumerate(word)]
        while len(ids) > 1:
            rank, at = min((self.ranks.get(pair, _INF), i) for i, pair in enumerate(zip(ids, ids[1:], strict=False)))
            if rank == _INF:
                break
            ids[at : at + 2] = [self.vocab[self.tokens[ids[at]] + self.tokens[ids[at + 1]]]]
        return ids

    def encode_words(self, words: Iterable[str]) -> dict[str, list[int]]:
        """Ids of distinct words of the byte alphabet. In sorted order each word follows the branch that it shares with the last one; the list of states is the path from the root."""
        if not self._goto:
            self._automaton()
        out: dict[str, list[int]] = {}
        goto, step, far, longest, shorter, length = self._goto, self._step, self._far, self._longest, self._shorter, self._length
        stays, meets = self.stays, self._meets.get
        if len(far) > self.MOST_FAR:
            far.clear()
        states, last = [0], [-1]  # by depth: the automaton's state; the last token (-1: none)
        before = ""
        for word in sorted(words):
            n, shared, top = len(word), 0, min(len(before), len(word) - 1, len(last) - 1)
            while shared < top and before[shared] == word[shared]:
                shared += 1
            del last[shared + 1 :], states[shared + 1 :]
            state = states[shared]
            for end in range(shared + 1, n + 1):
                c = word[end - 1] if end < n else chr(ord(word[n - 1]) + 0x1000)
                to = goto[state].get(c)
                if to is None:
                    way = state << 16 | ord(c)  # closed() symbols of the byte alphabet take 13 bits
                    to = far.get(way)
                    if to is None:
                        to = far[way] = step(state, c)
                state = to
                token = longest[state]
                while token >= 0:
                    size = length[token]
                    if size == end:
                        break
                    left = last[end - size]
                    if left >= 0:
                        good = meets(left << 32 | token)
                        if good or good is None and stays(left, token):
                            break
                    token = shorter[token]
                states.append(state)
                last.append(token)
            ids, end = [], n
            while end and last[end] >= 0:
                ids.append(last[end])
                end -= length[last[end]]
            ids.reverse()
            out[word] = self._merged(word) if end else ids
            del last[n:], states[n:]  # the word's end is no prefix of another word
            before = word
        return out

    def encode_chunks(self, chunks: Iterable[str]) -> dict[str, list[int]]:
        """Ids of distinct chunks, by the trie of their distinct words."""
        cut = {c: self.pieces(c) for c in chunks}
        met = {p for pieces in cut.values() for p in pieces if isinstance(p, str)}
        known = self._words
        if len(known) + len(met) > self.most_words:
            known.clear()
        long = {p for p in met if len(p) > 64}  # not kept: their size has no bound
        known |= self.encode_words(met - known.keys() - long)
        known = known | self.encode_words(long) if long else known

        out = {}
        for c, pieces in cut.items():
            if len(pieces) == 1 and (one := known.get(pieces[0])):
                out[c] = one
            else:
                out[c] = [i for p in pieces for i in (known[p] if isinstance(p, str) else (p,))]
        return out

    def encode(self, text: str) -> list[int]:
        chunks = self.chunks(text)
        known = self.encode_chunks(set(chunks))
        return [i for c in chunks for i in known[c]]

    def decode(self, ids: Iterable[int]) -> str:
        """The tokens of ids, joined by spaces, as a file without a decoder has it; special tokens included, unknown ids left out."""
        return " ".join([t for t in map(self.tokens.get, ids) if t is not None])


class Packed(dict):
    """Ids of chunks as bytes, made when first asked for: little-endian 32-bit integers."""

    def __init__(self, make):
        super().__init__()
        self.make, self.long = make, []

    def __missing__(self, chunk: str) -> bytes:
        out = self[chunk] = self.make(chunk)
        if len(chunk) > LibraryBpe.LONGEST:
            self.long.append(chunk)
        return out


class LibraryBpe(WordBpe):
    """The same texts and pieces, with the words' ids from the tokenizers library; for stages that need ids, not the trie.

    packed() keeps the ids of chunks and words met, of LONGEST characters at most each and so many that they take a
    bounded number of bytes."""

    LONGEST, MOST = 64, 150_000

    def __init__(self, path: str):
        super().__init__(path)
        self._model = Tokenizer.from_file(path).model
        self._held = Packed(self.chunk_bytes)
        self._of_word: dict[str, bytes] = {}
        self._stops = {c: self.word_bytes(c) for c in ".,!"}

    def encode_words(self, words: Iterable[str]) -> dict[str, list[int]]:
        tokenize = self._model.tokenize
        return {w: [t.id for t in tokenize(w)] for w in words}

    def word_bytes(self, word: str) -> bytes:
        """Ids of a word of the byte alphabet as little-endian 32-bit integers."""
        out = self._of_word.get(word)
        if out is None:
            out = array("I", [t.id for t in self._model.tokenize(word)]).tobytes()
            if len(word) <= self.LONGEST:
                self._of_word[word] = out
        return out

    def chunk_bytes(self, chunk: str) -> bytes:
        """Ids of a chunk as little-endian 32-bit integers; letters alone, or with one stop, take no pattern."""
        stop = self._stops.get(chunk[-1])
        core = chunk if stop is None else chunk[:-1]
        if core.isalpha():
            word = None
            if core.isascii():
                word = core.lower()
            elif "Σ" not in core and unicodedata.is_normalized("NFC", core):
                low = core.lower()
                word = low.encode().decode("latin-1").translate(self._bytes) if low.isalpha() else None
            if word is not None:
                out = self._of_word.get(word) or self.word_bytes(word)
                return out if stop is None else out + stop
        return b"".join([self.word_bytes(p) if isinstance(p, str) else array("I", (p,)).tobytes() for p in self.pieces(chunk)])

    def packed(self) -> Packed:
        """What gives the ids of any chunk. Asked for before each run of texts, it forgets what is long, and all once there is too much."""
        for chunk in self._held.long:
            del self._held[chunk]
        self._held.long.clear()
        if len(self._held) > self.MOST:
            self._held.clear()
        if len(self._of_word) > self.MOST:
            self._of_word.clear()
        return self._held


@lru_cache(maxsize=4)
def loaded(path: str, kind: type[WordBpe] = WordBpe) -> WordBpe:
    """The vocabulary at path, read once a process."""
    return kind(path)


def default_vocabulary() -> str:
    """Where the public vocabulary lies."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class ChunkCache:
    """What a process keeps of the chunks that it has met: forms(ids) of each, most entries at most, then it starts afresh. Chunks of over longest characters are held until the next call only."""

    longest = 64

    def __init__(self, bpe: WordBpe, forms: int, make, most: int = 400_000):
        self.bpe, self.make, self.most = bpe, make, most
        self.of: list[dict] = [{} for _ in range(forms)]
        self.long: list[str] = []

    def learn(self, texts: list[list[str]]) -> None:
        """Makes sure that all chunks of texts are held."""
        met = set().union(*texts)
        for chunk in self.long:
            for d in self.of:
                d.pop(chunk, None)
        self.long = [c for c in met if len(c) > self.longest]
        gc.disable()  # many small lists and no cycles
        try:
            if len(self.of[0]) + len(met) > self.most + len(met & self.of[0].keys()):
                for k, d in enumerate(self.of):  # what was just met goes on
                    self.of[k] = {c: d[c] for c in met if c in d}
            new = self.bpe.encode_chunks(met - self.of[0].keys())
            for d, forms in zip(self.of, zip(*map(self.make, new.values()), strict=True)):  # none if nothing is new
                d.update(zip(new, forms, strict=True))
        finally:
            gc.enable()


def groups(texts: list[str | None], most: int = 1 << 22) -> Iterator[list[str]]:
    """Texts in runs of about most characters; null is empty."""
    part, size = [], 0
    for t in texts:
        part.append(t or "")
        size += len(part[-1])
        if size >= most:
            yield part
            part, size = [], 0
    if part:
        yield part


_CACHES: dict[tuple[str, str], ChunkCache] = {}


def process_cache(kind: str, path: str, forms: int, make, by: type[WordBpe] = WordBpe) -> ChunkCache:
    """The process's cache of a kind, which lasts over tasks."""
    if (kind, path) not in _CACHES:
        _CACHES[kind, path] = ChunkCache(loaded(path, by), forms, make(loaded(path, by)))
    return _CACHES[kind, path]


def _shown(bpe: WordBpe):
    """Ids to their decimals and to their tokens, each joined by spaces, in UTF-8."""
    decimals, tokens = {i: b"%d" % i for i in bpe.tokens}, {i: t.encode() for i, t in bpe.tokens.items()}
    return lambda ids: (b" ".join([decimals[i] for i in ids]), b" ".join([tokens[i] for i in ids]))


def round_trip_digests(documents: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document, one row for one.

    Whole texts are encoded; null counts as empty, and an empty text has no ids and decodes to the empty
    string. Repeated rows and null ids are kept as they are; other columns are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = process_cache("texts", vocabulary, 2, _shown)
        for batch in batches:
            at = 0
            for texts in groups(batch.column(1).to_pylist()):
                chunks = [cache.bpe.chunks(t) for t in texts]
                cache.learn(chunks)
                ids_of, text_of = (d.__getitem__ for d in cache.of)
                counts, ids_hash, text_hash = [], [], []
                for c in chunks:
                    ids = b" ".join(map(ids_of, c))
                    counts.append(ids.count(b" ") + 1 if ids else 0)
                    ids_hash.append(hashlib.sha256(ids).hexdigest())
                    text_hash.append(hashlib.sha256(b" ".join(map(text_of, c))).hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array(counts, pa.int64()), pa.array(ids_hash), pa.array(text_hash)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
                at += len(texts)

    kind = documents.schema[id_col].dataType.simpleString()
    return documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encoded(documents: DataFrame, vocabulary: str, text_col: str = "text", into: str = "ids") -> DataFrame:
    """documents with the column into, the ids (array<int>) of the text; null counts as empty. An older column of that name is replaced."""
    keep = documents.drop(into)
    schema = T.StructType([*keep.schema.fields, T.StructField(into, T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = process_cache("ids", vocabulary, 1, lambda bpe: lambda ids: (ids,))
        for batch in batches:
            out = []
            for texts in groups(batch.column(text_col).to_pylist()):
                chunks = [cache.bpe.chunks(t) for t in texts]
                cache.learn(chunks)
                out += [[i for c in row for i in cache.of[0][c]] for row in chunks]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.int32()))], names=[*batch.schema.names, into])

    return keep.mapInArrow(run, schema)


def decoded(rows: DataFrame, vocabulary: str, ids_col: str = "ids", into: str = "text") -> DataFrame:
    """rows with the column into, the text of the ids; null ids count as none."""
    keep = rows.drop(into)
    schema = T.StructType([*keep.schema.fields, T.StructField(into, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(vocabulary)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([bpe.decode(ids or []) for ids in batch.column(ids_col).to_pylist()], pa.string())], names=[*batch.schema.names, into])

    return keep.mapInArrow(run, schema)


def op2_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded with the public word vocabulary."""
    return round_trip_digests(table(spark, sf_dir, "documents"), default_vocabulary())
