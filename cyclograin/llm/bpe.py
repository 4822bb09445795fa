"""Byte-level BPE with a minimal acyclic transducer of frequent words.

Texts are cut into pre-tokens with array operations. The most frequent pre-tokens of the corpus are
compiled into a minimal acyclic automaton: words share prefixes and suffixes, and the numbers on
its edges add up to a word's place, which leads to its ids. The file is sent to the executors
(``SparkContext.addFile``) and memory-mapped by their workers. A batch's distinct words walk the
automaton together; words it does not hold are merged exactly by the vocabulary's ranks.

Edge cases: null and empty texts have no tokens and decode to the empty text; the special token's
string in a text is the special token, as in the tokenizers library; a word of any length is
merged exactly. Repeated rows each give a row. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import tempfile
import unicodedata
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cyclograin.llm import textkit
from cyclograin.operators.attach import settled

#: words in the automaton at most
LEXICON = 50_000
COUNT_CHUNK = 1 << 21
#: words longer than this many bytes are merged one by one with a heap
LONG = 256
SPACE, LETTER, NUMBER, OTHER, EDGE = range(5)
BREAK, SPECIAL = 0x110000, 0x110001
_NONE = np.int64(1 << 40)
# White space and the contractions of the published pre-tokenizer pattern.
WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")

def classes() -> np.ndarray:
    """The class of every code point and of the two marks; made once, on the driver."""
    table = np.full(0x110002, OTHER, dtype=np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            table[c] = LETTER
        elif kind == "N":
            table[c] = NUMBER
    table[WHITE] = SPACE
    table[[BREAK, SPECIAL]] = EDGE
    return table


def token_starts(codes: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Positions where pre-tokens begin in an array of code points (with breaks between texts)."""
    kind = kinds[codes]
    n = len(codes)
    start = np.ones(n, dtype=bool)
    start[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == EDGE)
    # the last white space before a word stands alone; a plain space joins the word
    last = np.zeros(n, dtype=bool)
    last[:-1] = (kind[:-1] == SPACE) & (kind[1:] != SPACE) & (kind[1:] != EDGE)
    start |= last
    joins = np.flatnonzero(last & (codes == 32)) + 1
    start[joins] = False
    quotes = np.flatnonzero(start & (codes == 39))
    if len(quotes):
        padded = np.concatenate((codes, np.full(3, BREAK, dtype=codes.dtype)))
        free = np.ones(len(quotes), dtype=bool)
        for text in CONTRACTIONS:
            match = free.copy()
            for k, ch in enumerate(text):
                match &= padded[quotes + 1 + k] == ord(ch)
            at = quotes[match]
            start[at + 1] = False
            after = at + 1 + len(text)
            start[after[after < n]] = True
            free &= ~match
    return np.flatnonzero(start)


class Pretokens:
    """Distinct pre-tokens of a chunk of texts, and every text as a run of their numbers."""

    def __init__(self, texts: list[bytes | None], special: bytes, kinds: np.ndarray):
        parts, ends, n = [], [], 0
        for raw in texts:
            text = raw or b""
            for k, piece in enumerate(text.split(special) if special and special in text else [text]):
                if k:
                    parts.append(np.array([SPECIAL], dtype=np.uint32))
                    n += 1
                codes = np.frombuffer(piece.decode("utf-8", "replace").encode("utf-32-le"), dtype=np.uint32)
                parts.append(codes)
                n += len(codes)
            parts.append(np.array([BREAK], dtype=np.uint32))
            n += 1
            ends.append(n)
        codes = np.concatenate(parts) if parts else np.empty(0, np.uint32)
        del parts
        at = token_starts(codes, kinds)
        edge = codes >= BREAK
        width = np.ones(len(codes), dtype=np.uint8)
        for least in (0x80, 0x800, 0x10000):
            width += codes >= least
        width[edge] = 1
        first = codes[at]
        starts = np.cumsum(np.add.reduceat(width, at, dtype=np.int64)) if len(at) else np.empty(0, np.int64)
        stops, starts = starts, np.concatenate(([0], starts[:-1])) if len(at) else starts
        del width
        codes = codes.copy()
        codes[edge] = 0
        self.buf = np.frombuffer(codes.tobytes().decode("utf-32-le").encode(), dtype=np.uint8)
        del codes, edge
        hashes = textkit.word_hashes(self.buf, starts, stops)
        # the marks hash like a zero byte and get numbers of their own
        hashes[first == SPECIAL] = 1
        hashes[first == BREAK] = 0
        distinct, where, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        self.starts, self.stops, self.inverse = starts[where], stops[where], inverse
        self.is_break = first[where] == BREAK
        self.is_special = first[where] == SPECIAL
        #: word positions where each text begins and ends (its break left out)
        cut = np.searchsorted(at, np.array(ends, dtype=np.int64) - 1) if ends else np.empty(0, np.int64)
        self.text_ends = cut
        self.text_starts = np.concatenate(([0], cut[:-1] + 1)) if len(cut) else cut

    def word(self, i: int) -> bytes:
        return self.buf[self.starts[i] : self.stops[i]].tobytes()


class Vocabulary:
    """Merges and token bytes of a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        # the file writes bytes as printable characters: the printable ones stand for themselves
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        rest = [b for b in range(256) if b not in set(plain)]
        byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
        self.special = {t["content"].encode(): t["id"] for t in spec.get("added_tokens", [])}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.token: list[bytes] = [b""] * size
        for text, i in vocab.items():
            self.token[i] = bytes(byte_of[c] for c in text)
        for raw, i in self.special.items():
            self.token[i] = raw
        self.of_byte = np.zeros(256, dtype=np.int64)
        for ch, b in byte_of.items():
            self.of_byte[b] = vocab[ch]
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] << 20 | vocab[b] for a, b in merges], dtype=np.int64)
        #: pairs of ids in ascending order with the rank of their merge, and what each merge makes
        self.rank = np.argsort(keys, kind="stable")
        self.keys = keys[self.rank]
        self.merged_of_rank = np.array([vocab[a + b] for a, b in merges], dtype=np.int64)
        self.decimal = [str(i) for i in range(size)]
        self.kinds = classes()

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 20 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], _NONE)

    def merge_long(self, word: bytes) -> list[int]:
        """Exact merge of one word in n log n steps: lowest rank first, leftmost among equals."""
        tok = self.of_byte[np.frombuffer(word, dtype=np.uint8)].tolist()
        n = len(tok)
        before, after, alive = list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n

        def rank(a: int, b: int) -> int:
            key = a << 20 | b
            k = int(np.searchsorted(self.keys, key))
            return int(self.rank[k]) if k < len(self.keys) and self.keys[k] == key else -1

        first = self.ranks(np.array(tok[:-1], dtype=np.int64), np.array(tok[1:], dtype=np.int64)).tolist()
        heap = [(r, i, tok[i], tok[i + 1]) for i, r in enumerate(first) if r < _NONE]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or tok[i] != a or j >= n or tok[j] != b:
                continue
            tok[i] = int(self.merged_of_rank[r])
            alive[j] = False
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for x in (before[i], i):
                if x >= 0 and after[x] < n and (r := rank(tok[x], tok[after[x]])) >= 0:
                    heapq.heappush(heap, (r, x, tok[x], tok[after[x]]))
        return [t for t, live in zip(tok, alive, strict=True) if live]

    def merge(self, flat: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exact merges of many short words at once: ids in one array and their number per word.

        Every round joins, in each word, the leftmost pair of lowest rank. Words without a
        mergeable pair leave the rounds.
        """
        n_words = len(lengths)
        tok, owner = self.of_byte[flat], np.repeat(np.arange(n_words), lengths)
        done_tok, done_owner = [], []
        rank = np.full(len(tok), _NONE)
        same = owner[1:] == owner[:-1]
        rank[:-1][same] = self.ranks(tok[:-1][same], tok[1:][same])
        while len(tok):
            first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            size = np.diff(np.append(first, len(tok)))
            low = np.minimum.reduceat(rank, first)
            ends = low == _NONE
            if ends.any():
                out = np.repeat(ends, size)
                done_tok.append(tok[out])
                done_owner.append(owner[out])
                tok, owner, rank = tok[~out], owner[~out], rank[~out]
                size, low = size[~ends], low[~ends]
                if not len(tok):
                    break
                first = np.cumsum(size) - size
            hit = np.flatnonzero(rank == np.repeat(low, size))
            which = owner[hit]
            at = hit[np.concatenate(([True], which[1:] != which[:-1]))]
            tok[at] = self.merged_of_rank[low]
            keep = np.ones(len(tok), dtype=bool)
            keep[at + 1] = False
            at = at - np.arange(len(at))
            tok, owner, rank = tok[keep], owner[keep], rank[keep]
            n = len(tok)
            for x in (at, at - 1):
                x = x[x >= 0]
                inner = (x + 1 < n) & (owner[np.minimum(x + 1, n - 1)] == owner[x])
                rank[x[~inner]] = _NONE
                x = x[inner]
                rank[x] = self.ranks(tok[x], tok[x + 1])
        if not done_tok:
            return np.empty(0, np.int64), np.zeros(n_words, dtype=np.int64)
        toks, owners = np.concatenate(done_tok), np.concatenate(done_owner)
        order = np.argsort(owners, kind="stable")
        return toks[order], np.bincount(owners, minlength=n_words)

    def encode_words(self, buf: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all given byte spans in order, and their number per span."""
        lengths = stops - starts
        long = lengths > LONG
        short = np.flatnonzero(~long)
        flat = buf[_ranges(starts[short], lengths[short])]
        ids, counts = self.merge(flat, lengths[short])
        if not long.any():
            return ids, counts
        offsets = np.cumsum(counts) - counts
        parts, number = [], np.zeros(len(starts), dtype=np.int64)
        number[short] = counts
        at = dict(zip(short.tolist(), range(len(short)), strict=True))
        for i in range(len(starts)):
            if i in at:
                k = at[i]
                parts.append(ids[offsets[k] : offsets[k] + counts[k]])
            else:
                parts.append(np.array(self.merge_long(buf[starts[i] : stops[i]].tobytes()), dtype=np.int64))
                number[i] = len(parts[-1])
        return np.concatenate(parts), number

    def decode(self, ids) -> bytes:
        """Bytes of a sequence of ids, special tokens included."""
        return b"".join(map(self.token.__getitem__, ids))


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions start, start + 1, ... of every range, one after another."""
    total = int(lengths.sum())
    begin = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
    return begin + np.arange(total)


def compile_lexicon(words: list[bytes], vocabulary: Vocabulary, path: str) -> None:
    """Write the minimal acyclic automaton of the words, with their ids, as arrays in one file."""
    words = sorted(set(words))
    edges: list[dict[int, int]] = [{}]
    final = [False]
    register: dict[tuple, int] = {}
    free: list[int] = []

    def new_state() -> int:
        if free:
            s = free.pop()
            edges[s], final[s] = {}, False
            return s
        edges.append({})
        final.append(False)
        return len(edges) - 1

    def fold(chain: list[tuple[int, int, int]], down_to: int) -> None:
        # states of the last word below the common prefix are final: replace them by equal ones
        while len(chain) > down_to:
            parent, byte, child = chain.pop()
            key = (final[child], tuple(edges[child].items()))
            known = register.setdefault(key, child)
            if known != child:
                edges[parent][byte] = known
                free.append(child)

    chain: list[tuple[int, int, int]] = []
    last = b""
    for word in words:
        common = len(os.path.commonprefix((last, word)))
        fold(chain, common)
        state = chain[-1][2] if chain else 0
        for byte in word[common:]:
            child = new_state()
            edges[state][byte] = child
            chain.append((state, byte, child))
            state = child
        final[state] = True
        last = word
    fold(chain, 0)

    live, below, stack = {}, {}, [(0, False)]
    while stack:
        s, seen = stack.pop()
        if seen:
            below[s] = int(final[s]) + sum(below[t] for t in edges[s].values())
        elif s not in live:
            live[s] = len(live)
            stack.append((s, True))
            stack.extend((t, False) for t in edges[s].values() if t not in live)
    key, target, skip = [], [], []
    for s, number in live.items():
        passed = int(final[s])
        for byte in sorted(edges[s]):
            t = edges[s][byte]
            key.append(number << 8 | byte)
            target.append(live[t])
            skip.append(passed)
            passed += below[t]
    ends = np.zeros(len(live), dtype=np.int32)
    for s, number in live.items():
        ends[number] = final[s]
    buf = np.frombuffer(b"".join(words), dtype=np.uint8)
    stops = np.cumsum(np.array([len(w) for w in words], dtype=np.int64))
    ids, counts = vocabulary.encode_words(buf, np.concatenate(([0], stops[:-1])).astype(np.int64) if words else stops, stops)
    places = np.concatenate(([0], np.cumsum(counts)))
    arrays = [np.array(a, dtype=np.int32) for a in (key, target, skip, ends, places, ids)]
    with open(path, "wb") as f:
        f.write(np.array([len(a) for a in arrays], dtype=np.int32).tobytes())
        for a in arrays:
            f.write(a.tobytes())


class Lexicon:
    """The compiled automaton, memory-mapped."""

    def __init__(self, path: str):
        sizes = np.fromfile(path, dtype=np.int32, count=6)
        data = np.memmap(path, dtype=np.int32, mode="r", offset=24) if sizes.sum() else np.empty(0, np.int32)
        cuts = np.concatenate(([0], np.cumsum(sizes)))
        self.key, self.target, self.skip, self.ends, self.places, self.ids = (data[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True))

    def find(self, buf: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """The number of each byte span's word, -1 where the automaton has none."""
        out = np.full(len(starts), -1, dtype=np.int64)
        if not len(self.key):
            return out
        active = np.arange(len(starts))
        state, passed = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        step = 0
        while len(active):
            over = starts[active] + step == stops[active]
            good = over & (self.ends[state] == 1)
            out[active[good]] = passed[good]
            active, state, passed = active[~over], state[~over], passed[~over]
            key = state << 8 | buf[starts[active] + step]
            at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            ok = self.key[at] == key
            active, at = active[ok], at[ok]
            passed = passed[ok] + self.skip[at]
            state = self.target[at].astype(np.int64)
            step += 1
        return out


class Encoder:
    """Texts to ids: the automaton for frequent words, exact merges for the rest."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon | None = None):
        self.vocabulary, self.lexicon = vocabulary, lexicon
        self.special, self.special_id = next(iter(vocabulary.special.items()), (b"", -1))

    def encode(self, texts: list[bytes | None]) -> Iterator[np.ndarray]:
        """The ids of each text."""
        pre = Pretokens(texts, self.special, self.vocabulary.kinds)
        n = len(pre.starts)
        counts, ids_at = np.zeros(n, np.int64), np.zeros(n, np.int64)
        plain = ~(pre.is_break | pre.is_special)
        pools = [np.array([self.special_id], dtype=np.int64)]
        counts[pre.is_special] = 1
        size = 1
        todo = np.flatnonzero(plain)
        if self.lexicon is not None:
            number = self.lexicon.find(pre.buf, pre.starts[todo], pre.stops[todo])
            known, number = todo[number >= 0], number[number >= 0]
            ids_at[known] = size + self.lexicon.places[number]
            counts[known] = self.lexicon.places[number + 1] - self.lexicon.places[number]
            pools.append(np.asarray(self.lexicon.ids, dtype=np.int64))
            size += len(pools[-1])
            rest = np.ones(n, dtype=bool)
            rest[known] = False
            todo = np.flatnonzero(plain & rest)
        ids, number = self.vocabulary.encode_words(pre.buf, pre.starts[todo], pre.stops[todo])
        ids_at[todo] = size + np.cumsum(number) - number
        counts[todo] = number
        pool = np.concatenate([*pools, ids])
        for a, b in zip(pre.text_starts, pre.text_ends, strict=True):
            words = pre.inverse[a:b]
            yield pool[_ranges(ids_at[words], counts[words])]


def word_counts(docs: DataFrame, text_col: str, special: bytes) -> DataFrame:
    """``word, n`` for every distinct pre-token of all texts."""
    kinds = docs.sparkSession.sparkContext.broadcast(classes())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in textkit.chunks(batches, "text", COUNT_CHUNK):
            pre = Pretokens(texts, special, kinds.value)
            n = np.bincount(pre.inverse, minlength=len(pre.starts))
            keep = np.flatnonzero(~(pre.is_break | pre.is_special))
            words = [pre.word(i) for i in keep.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(n[keep])], names=["word", "n"])

    rows = docs.select(F.col(text_col).alias("text")).filter(F.col("text").isNotNull())
    return rows.mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(docs: DataFrame, text_col: str, special: bytes = b"", size: int = LEXICON) -> list[bytes]:
    """The most frequent pre-tokens, ``size`` at most: those above the smallest count that allows it.

    The choice only decides which words skip merging; ids do not depend on it.
    """
    counts = settled(word_counts(docs, text_col, special).filter("n > 1"))
    levels = counts.groupBy("n").agg(F.count("*").alias("words")).orderBy(F.col("n").desc())
    total, least = 0, None
    for r in levels.toLocalIterator():
        total += r["words"]
        if total > size:
            break
        least = r["n"]
    if least is None:
        return []
    return [bytes(r["word"]) for r in counts.filter(F.col("n") >= least).select("word").collect()]


class Codec:
    """A vocabulary (broadcast: its size is fixed) and a compiled lexicon at hand in every worker."""

    def __init__(self, docs: DataFrame, text_col: str, vocabulary_path: str, size: int = LEXICON):
        vocabulary = Vocabulary(vocabulary_path)
        special = next(iter(vocabulary.special), b"")
        words = frequent_words(docs, text_col, special, size)
        self.lexicon_name = f"lexicon-{uuid.uuid4().hex}.bin"
        path = f"{tempfile.mkdtemp(prefix='lexicon-')}/{self.lexicon_name}"
        compile_lexicon(words, vocabulary, path)
        context = docs.sparkSession.sparkContext
        context.addFile(path)
        self.vocabulary = context.broadcast(vocabulary)

    def encoder(self) -> Encoder:
        return Encoder(self.vocabulary.value, Lexicon(SparkFiles.get(self.lexicon_name)))


def encode(docs: DataFrame, codec: Codec, text_col: str, carry: list[str]) -> DataFrame:
    """``carry`` with ``ids``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = codec.encoder()
        for piece, texts in textkit.chunks(batches, "_text"):
            ids = [x.astype(np.int32) for x in encoder.encode(texts)]
            yield pa.RecordBatch.from_arrays([*piece.columns[:-1], pa.array(ids, pa.list_(pa.int32()))], names=[*piece.schema.names[:-1], "ids"])

    rows = docs.select(*carry, F.col(text_col).alias("_text"))
    return rows.mapInArrow(run, rows.drop("_text").schema.add("ids", T.ArrayType(T.IntegerType())))


def decode(tokens: DataFrame, codec: Codec, ids_col: str, carry: list[str]) -> DataFrame:
    """``carry`` with ``decoded``: the text of each row's ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = codec.vocabulary.value
        for batch in batches:
            out = [token.decode(ids or ()).decode("utf-8", "replace") for ids in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.string())], names=[*batch.schema.names[:-1], "decoded"])

    rows = tokens.select(*carry, F.col(ids_col).alias("_ids"))
    return rows.mapInArrow(run, rows.drop("_ids").schema.add("decoded", "string"))


def round_trip(docs: DataFrame, codec: Codec, text_col: str, carry: list[str]) -> DataFrame:
    """``carry`` with the digests of encoding and of decoding those ids, without moving the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = codec.encoder()
        decimal = encoder.vocabulary.decimal
        for piece, texts in textkit.chunks(batches, "_text"):
            n, ids_sha, text_sha = [], [], []
            for ids in encoder.encode(texts):
                ids = ids.tolist()
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(",".join(map(decimal.__getitem__, ids)).encode()).hexdigest())
                text = encoder.vocabulary.decode(ids).decode("utf-8", "replace")
                text_sha.append(hashlib.sha256(text.encode()).hexdigest())
            cols = [*piece.columns[:-1], pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=[*piece.schema.names[:-1], "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(*carry, F.col(text_col).alias("_text"))
    schema = rows.drop("_text").schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")
    return rows.mapInArrow(run, schema)
