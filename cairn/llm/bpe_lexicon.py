"""Byte-level BPE through a lexicon of frequent words: a minimal acyclic automaton that numbers its words, with the words' ids beside it.

A word is what lies between white space, with the one space before it; pieces of the tokenizer never span two words. The corpus is
counted once. Its most frequent words go into an automaton that shares prefixes and suffixes; a transition adds to the word's number how
many words it passes by, so the number leads to the word's ids. The automaton is a double array, one file that
every worker maps into memory; all words of a slice walk it side by side. Words it doesn't have are merged exactly.
"""

from __future__ import annotations

import hashlib
import heapq
import io
import json
import os
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import lean, shared_dir, stage, write_bytes
from cairn.llm.letters import Pieces
from cairn.llm.token_files import byte_alphabet, slices

#: Words in the lexicon; most of them a worker counts or remembers before it lets go of them.
LEXICON_WORDS, HELD_WORDS = 1 << 16, 120_000
#: Longer pieces are merged one by one, through a heap.
LONG_PIECE, _NO_RANK = 48, 1 << 40
#: The tokenizer's white space (Unicode's), and its pattern for pieces.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_PIECES = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
_WORDS = re.compile(rb" ?[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+(?![^\x20\x09-\x0D])|[\x20\x09-\x0D]")
#: The white space of more than one byte, in UTF-8.
_WIDE_SPACE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")


class Merges:
    """The tokenizer's own rules: pieces, merges by rank, special tokens, and bytes by id."""

    _held: dict = {}

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letter = byte_alphabet()
        back = {c: b for b, c in enumerate(letter)}
        vocab, rules = spec["model"]["vocab"], spec["model"]["merges"]
        self.of_byte = [vocab.get(c) for c in letter]
        self.rank = {}
        for k, rule in enumerate(rules):
            a, b = rule if isinstance(rule, list) else rule.split(" ")
            self.rank.setdefault((vocab[a], vocab[b]), (k, vocab[a + b]))
        self.special = {t["content"].encode(): t["id"] for t in spec.get("added_tokens") or ()}
        self.bytes = [b""] * (1 + max([*vocab.values(), *self.special.values()]))
        for t, i in vocab.items():
            self.bytes[i] = bytes(back[c] for c in t)
        for t, i in self.special.items():
            self.bytes[i] = t
        self.decimal = [b"%d" % i for i in range(len(self.bytes))]
        self.pieces = Pieces(_PIECES)
        longest = sorted(map(re.escape, self.special), key=len, reverse=True)
        self.split = re.compile(b"(" + b"|".join(longest) + b")") if longest else None
        self.known: dict[bytes, bytes] = {}
        self.known_pieces: dict[bytes, bytes] = {}
        self.byte_ids = np.array([-1 if x is None else x for x in self.of_byte], np.int64)
        self.made = np.array([to for _, to in sorted(self.rank.values())], np.int64)
        by_rank = {r: k for k, (r, _) in enumerate(sorted(self.rank.values()))}
        # pairs in an open table, at the first free slot from their hash on
        self.bits = max(8, (4 * len(self.rank)).bit_length())
        self.pair, self.pair_rank = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, _NO_RANK, np.int64)
        for (a, b), (r, _) in self.rank.items():
            at = int(self._slot(np.array([a << 32 | b]))[0])
            while self.pair[at] >= 0:
                at = (at + 1) % len(self.pair)
            self.pair[at], self.pair_rank[at] = a << 32 | b, by_rank[r]

    @classmethod
    def of(cls, path: str) -> Merges:
        if path not in cls._held:
            cls._held[path] = cls(path)
        return cls._held[path]

    def merge(self, piece: bytes) -> list[int]:
        """The piece's ids: of all neighbours the pair of least rank, leftmost first, is merged until none is left."""
        ids, rank = [self.of_byte[b] for b in piece], self.rank
        if len(ids) > LONG_PIECE:
            return self._merge_long(ids)
        while len(ids) > 1:
            best, at = None, 0
            for i, pair in enumerate(zip(ids, ids[1:])):
                r = rank.get(pair)
                if r is not None and (best is None or r[0] < best[0]):
                    best, at = r, i
            if best is None:
                break
            ids[at : at + 2] = [best[1]]
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        rank, n = self.rank, len(ids)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        queue = [(r[0], i, ids[i], ids[i + 1], r[1]) for i in range(n - 1) if (r := rank.get((ids[i], ids[i + 1])))]
        heapq.heapify(queue)
        while queue:
            _, i, a, b, to = heapq.heappop(queue)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = to, -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for p in (before[i], i):
                q = after[p] if p >= 0 else -1
                if q >= 0 and (r := rank.get((ids[p], ids[q]))):
                    heapq.heappush(queue, (r[0], p, ids[p], ids[q], r[1]))
        return [x for x in ids if x >= 0]

    def _slot(self, pair: np.ndarray) -> np.ndarray:
        return ((pair.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair of ids, _NO_RANK where no rule merges it."""
        pair = a << 32 | b
        at = self._slot(pair)
        out, todo = np.full(len(pair), _NO_RANK, np.int64), np.arange(len(pair))
        while len(todo):
            there = self.pair[at]
            hit = there == pair
            out[todo[hit]] = self.pair_rank[at[hit]]
            on = ~hit & (there >= 0)
            todo, pair, at = todo[on], pair[on], (at[on] + 1) % len(self.pair)
        return out

    def merge_all(self, pieces: list[bytes]) -> list[bytes]:
        """merge() of many short pieces side by side, each as packed 4-byte ids: a round merges the next pair of every piece."""
        out: list = [b""] * len(pieces)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ids, name = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)], np.repeat(np.arange(len(pieces)), sizes)
        rank = np.full(len(ids), _NO_RANK, np.int64)
        inner = np.nonzero(name[1:] == name[:-1])[0]
        rank[inner] = self.ranks(ids[inner], ids[inner + 1])
        while len(ids):
            starts = np.nonzero(np.concatenate([[True], name[1:] != name[:-1]]))[0]
            least = np.minimum.reduceat(rank, starts)
            size = np.diff(np.append(starts, len(ids)))
            done = least == _NO_RANK
            if done.any():
                gone = np.repeat(done, size)
                packed, ends = ids[gone].astype("<u4").tobytes(), np.cumsum(size[done]) * 4
                for k, a, b in zip(name[starts[done]].tolist(), [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                    out[k] = packed[a:b]
                ids, name, rank, least, size = ids[~gone], name[~gone], rank[~gone], least[~done], size[~done]
                if not len(ids):
                    break
            at = np.nonzero(rank == np.repeat(least, size))[0]
            at = at[np.concatenate([[True], name[at][1:] != name[at][:-1]])]  # the leftmost of each piece
            ids[at] = self.made[rank[at]]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            at -= np.arange(len(at))  # where they are without the ids that went before
            ids, name, rank = ids[keep], name[keep], rank[keep]
            rank[at] = _NO_RANK
            for left in (at - 1, at):
                left = left[(left >= 0) & (left + 1 < len(ids))]
                left = left[name[left] == name[left + 1]]
                rank[left] = self.ranks(ids[left], ids[left + 1])
        return out

    def words(self, words: list[bytes]) -> list[bytes]:
        """The ids of each run of text without special tokens, packed in 4 bytes each, and remembered."""
        for held in (self.known, self.known_pieces):
            if len(held) > HELD_WORDS:
                held.clear()
        cut, new = {}, {}
        for w in words:
            if w not in self.known:
                cut[w] = own = [w] if w.isalpha() or w[:1] == b" " and w[1:].isalpha() else [p.encode() for p in self.pieces(w.decode())]
                for p in own:
                    if p not in self.known_pieces:
                        new[p] = None
        short = [p for p in new if len(p) <= LONG_PIECE]
        self.known_pieces.update(zip(short, self.merge_all(short), strict=True))
        self.known_pieces.update((p, np.array(self.merge(p), "<u4").tobytes()) for p in new if len(p) > LONG_PIECE)
        for w, own in cut.items():
            self.known[w] = b"".join([self.known_pieces[p] for p in own])
        return [self.known[w] for w in words]

    def word(self, word: bytes) -> np.ndarray:
        return np.frombuffer(self.words([word])[0], "<u4")

    def segments(self, text: bytes) -> list[bytes]:
        """The text cut at special tokens: each second part is one."""
        return self.split.split(text) if any(map(text.__contains__, self.special)) else [text]


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n) over all texts; tasks add up before anything moves."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        out = lambda: pa.record_batch([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
        for b in slices(batches, 0):
            for t in b.column(0).cast(pa.binary()).to_pylist():
                t = t or b""
                held.update(_WORDS.findall(t if t.isascii() else _WIDE_SPACE.sub(b"\n", t)))
            if len(held) > HELD_WORDS:
                yield out()
                held.clear()
        yield out()

    return docs.select(F.col(text_col).alias("t")).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(counts: DataFrame, most: int = LEXICON_WORDS, top: int = 4096) -> list[bytes]:
    """At most `most` words, the most frequent; a count that would exceed it is left out whole. The driver gets these and `top` numbers."""
    by_n = dict(counts.groupBy(F.least("n", F.lit(top)).alias("n")).count().collect())
    least, total = top, by_n.get(top, 0)
    if total > most:
        rows = counts.where(F.col("n") >= top).orderBy(F.desc("n"), "word").limit(most)
    else:
        while least > 1 and total + by_n.get(least - 1, 0) <= most:
            least -= 1
            total += by_n.get(least, 0)
        rows = counts.where(F.col("n") >= least)
    return sorted(bytes(r[0]) for r in rows.select("word").collect())


class Lexicon:
    """A numbered automaton over words as a double array: base by state; owner, target and skip by slot; final by state; ids by word."""

    FIELDS = ("base", "final", "owner", "target", "skip", "starts", "ids")

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.__dict__.update(arrays)

    @classmethod
    def build(cls, words: list[bytes], outputs: list[np.ndarray]) -> Lexicon:
        """words: sorted and distinct. States are made equal as soon as no later word can change them."""
        register: dict = {}

        def settle(path, down_to):
            while len(path) > down_to:
                final, edges, label = path.pop()
                path[-1][1].append((label, register.setdefault((final, tuple(edges)), len(register))))

        path = [[False, [], -1]]
        last = b""
        for w in words:
            same = os.path.commonprefix([last, w])
            settle(path, len(same) + 1)
            path += [[False, [], c] for c in w[len(same) :]]
            path[-1][0] = True
            last = w
        settle(path, 1)
        root = register.setdefault((path[0][0], tuple(path[0][1])), len(register))
        states = list(register)
        held = np.zeros(len(states), np.int64)
        for s, (final, edges) in enumerate(states):
            held[s] = final + sum(held[t] for _, t in edges)
        room = 1024 + 3 * sum(len(e) for _, e in states)
        taken, base, free, near, high = bytearray(room), np.zeros(len(states), np.int32), 256, 0, 0
        owner, target, skip = np.full(room, -1, np.int32), np.zeros(room, np.int32), np.zeros(room, np.int32)
        for s in sorted(range(len(states)), key=lambda s: -len(states[s][1])):
            final, edges = states[s]
            if not edges:
                continue
            if len(edges) == 1:  # fills any gap from slot 256 on
                while taken[free]:
                    free += 1
                at = free - edges[0][0]
            else:  # a few tries, then past all others: gaps cost less than the search
                at = near
                while any(taken[at + c] for c, _ in edges):
                    at += 1
                    if at > near + 64:
                        at = near = max(near, high) + 256
            high = max(high, at + 1)
            if at + 512 > len(taken):
                more = len(taken)
                taken += bytearray(more)
                owner, target, skip = (np.concatenate([x, np.full(more, f, np.int32)]) for x, f in ((owner, -1), (target, 0), (skip, 0)))
            base[s], passed = at, int(final)
            for c, t in edges:
                taken[at + c], owner[at + c], target[at + c], skip[at + c] = 1, s, t, passed
                passed += int(held[t])
        starts = np.concatenate([[0], np.cumsum([len(x) for x in outputs])]).astype(np.int32)
        arrays = {"base": base, "final": np.array([f for f, _ in states], np.int32), "owner": owner, "target": target, "skip": skip, "starts": starts, "ids": np.concatenate([np.zeros(0, np.uint32), *outputs]).astype(np.int32)}
        return cls(arrays | {"root": root})

    def dump(self) -> bytes:
        """The content of a file that map() reads."""
        parts, out = [getattr(self, f) for f in self.FIELDS], io.BytesIO()
        np.save(out, np.concatenate([np.array([self.root, *map(len, parts)], np.int32), *parts]))
        return out.getvalue()

    @classmethod
    def map(cls, path: str) -> Lexicon:
        data = np.load(path, mmap_mode="r")
        at, arrays = 1 + len(cls.FIELDS), {"root": int(data[0])}
        for f, n in zip(cls.FIELDS, data[1:at].tolist(), strict=True):
            arrays[f], at = data[at : at + n], at + n
        return cls(arrays)

    def numbers(self, text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number of each word text[start:end], -1 if the lexicon lacks it."""
        out = np.full(len(starts), -1, np.int64)
        if not len(self.starts) - 1:
            return out
        who, at, state, number = np.arange(len(starts)), starts.copy(), np.full(len(starts), self.root, np.int32), np.zeros(len(starts), np.int64)
        while len(who):
            over = at >= ends[who]
            if over.any():
                done = over & (self.final[state] > 0)
                out[who[done]] = number[done]
                who, at, state, number = (x[~over] for x in (who, at, state, number))
            slot = self.base[state] + text[at]
            here = self.owner[slot] == state
            if not here.all():
                who, at, slot, number = (x[here] for x in (who, at, slot, number))
            state, number, at = self.target[slot], number + self.skip[slot], at + 1
        return out


def word_spans(text: np.ndarray, doc_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of all words of texts that lie end to end, white space included.

    Of white space before a word the last character goes by itself, a space with the word; what comes before it is a word too, and
    so is all white space at a text's end. Where no white space is wide that is what _WORDS finds.
    """
    n = len(text)
    white = (text == 32) | (text - np.uint8(9) < 5)
    wide = _wide(text)
    for k, at in wide.items():
        for i in range(k):
            white[at + i] = True
    edge = np.zeros(n + 1, bool)
    edge[doc_ends] = True
    edge[0] = True
    new = edge[:n].copy()  # a run starts where the kind changes or a document begins
    new[1:] |= white[1:] != white[:-1]
    starts = np.nonzero(new)[0]
    ends = np.append(starts[1:], n)
    blank = white[starts]
    last = edge[ends] & blank  # white space that ends its document stays whole
    inner, words = np.nonzero(blank & ~last)[0], np.nonzero(~blank)[0]
    space = text[ends[inner] - 1] == 32
    # the last space before a word goes with it; another last character is a word of its own, and so is what comes before
    word_starts = starts[words].copy()
    led = np.searchsorted(words, inner[space] + 1)
    word_starts[led] -= 1
    cut = ends[inner] - 1
    if wide:  # to the first byte of the last character
        for _ in range(2):
            cut -= text[cut] & 0xC0 == 0x80
    head, tail = cut > starts[inner], ~space
    s = np.concatenate([starts[inner][head], cut[tail], word_starts, starts[last]])
    e = np.concatenate([cut[head], ends[inner][tail], ends[words], ends[last]])
    order = np.argsort(s, kind="stable")
    return s[order], e[order]


def _wide(text: np.ndarray) -> dict[int, np.ndarray]:
    """Where white space of two and three bytes begins, by its length; empty if there is none."""
    lead = np.nonzero((text == 0xC2) | (text == 0xE1) | (text == 0xE2) | (text == 0xE3))[0]
    if not len(lead):
        return {}
    one, two, three = (np.append(text, np.zeros(2, np.uint8))[lead + i] for i in range(3))
    is_two = (one == 0xC2) & ((two == 0x85) | (two == 0xA0))
    general = (one == 0xE2) & (two == 0x80) & ((three - np.uint8(0x80) < 11) | (three == 0xA8) | (three == 0xA9) | (three == 0xAF))
    is_three = general | (one == 0xE1) & (two == 0x9A) & (three == 0x80) | (one == 0xE2) & (two == 0x81) & (three == 0x9F) | (one == 0xE3) & (two == 0x80) & (three == 0x80)
    return {k: lead[m] for k, m in ((2, is_two), (3, is_three)) if m.any()}


_LEXICONS: dict[str, Lexicon] = {}


def encode_slice(texts: list[bytes], rules: Merges, lexicon: Lexicon) -> list[np.ndarray]:
    """Each text's ids."""
    parts = [rules.segments(t) for t in texts]
    if any(len(p) > 1 for p in parts):  # texts between special tokens are texts of their own
        inner = iter(encode_slice([x for p in parts for x in p[::2]], rules, lexicon))
        special = lambda x: np.array([rules.special[x]], np.uint32)
        return [np.concatenate([special(x) if k % 2 else next(inner) for k, x in enumerate(p)]) for p in parts]
    joined = b"".join(texts)
    doc_ends = np.cumsum([len(t) for t in texts]) if texts else np.zeros(0, np.int64)
    if not joined:
        return [np.zeros(0, np.uint32)] * len(texts)
    buf = np.frombuffer(joined, np.uint8)
    starts, ends = word_spans(buf, doc_ends)
    number = lexicon.numbers(buf, starts, ends)
    unseen = np.nonzero(number < 0)[0]
    names: dict[bytes, int] = {}
    number[unseen] = [-1 - names.setdefault(joined[a:b], len(names)) for a, b in zip(starts[unseen].tolist(), ends[unseen].tolist(), strict=True)]
    merged = rules.words(list(names))
    ids = np.concatenate([lexicon.ids, np.frombuffer(b"".join(merged), "<u4").astype(np.int32)])
    new_ends = np.cumsum([len(x) // 4 for x in merged], dtype=np.int64) if merged else np.zeros(0, np.int64)
    all_starts = np.concatenate([lexicon.starts, len(lexicon.ids) + new_ends])  # word k of the new ones is at len(lexicon.starts) - 1 + k
    at = np.where(number >= 0, number, len(lexicon.starts) - 2 - number)
    first, size = all_starts[at].astype(np.int64), (all_starts[at + 1] - all_starts[at]).astype(np.int64)
    upto = np.cumsum(size)
    flat = ids[np.repeat(first - (upto - size), size) + np.arange(upto[-1])]
    cuts = np.searchsorted(starts, doc_ends)  # words before each document's end
    to = np.concatenate([[0], upto])[cuts]
    return [flat[a:b].astype(np.uint32) for a, b in zip([0, *to[:-1].tolist()], to.tolist(), strict=True)]


def train_lexicon(docs: DataFrame, tokenizer: str, text_col: str = "text", words: int = LEXICON_WORDS) -> str:
    """Counts the corpus, builds the lexicon, and hands its file to every executor; returns the file's name there."""
    # a word seen once is not frequent, and half of all words are such
    found = frequent_words(stage(word_counts(docs, text_col).where("n > 1")), words)
    rules = Merges.of(tokenizer)
    found = [w for w in found if len(rules.segments(w)) == 1]
    lexicon = Lexicon.build(found, [np.frombuffer(x, "<u4") for x in rules.words(found)])
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}.npy"
    write_bytes(spark, path, lexicon.dump())
    spark.sparkContext.addFile(path)  # executors fetch it from the shared folder, those that come later too
    return os.path.basename(path)


def _encoded(docs: DataFrame, columns: list, schema: str, text_col: str, tokenizer: str, lexicon_words: int, digest: bool) -> DataFrame:
    name = train_lexicon(docs, tokenizer, text_col, lexicon_words)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = Merges.of(tokenizer)
        if name not in _LEXICONS:
            _LEXICONS.clear()
            _LEXICONS[name] = Lexicon.map(SparkFiles.get(name))
        lexicon = _LEXICONS[name]
        for b in slices(batches, b_text, 512, 1 << 20):
            texts = [t or b"" for t in b.column(b_text).cast(pa.binary()).to_pylist()]
            ids = encode_slice(texts, rules, lexicon)
            n = pa.array([len(x) for x in ids], pa.int64())
            if digest:
                lists = [x.tolist() for x in ids]
                sha = pa.array([hashlib.sha256(b",".join(map(rules.decimal.__getitem__, x))).hexdigest() for x in lists])
                back = pa.array([hashlib.sha256(decode(x, rules).encode()).hexdigest() for x in lists])
                yield pa.record_batch([*b.columns[:b_text], n, sha, back], names=names)
            else:
                flat = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(n)]).astype(np.int32), np.concatenate([np.zeros(0, np.uint32), *ids]).astype(np.int32))
                yield pa.record_batch([*b.columns[:b_text], flat, n], names=names)

    b_text, names = len(columns), [x.split(" ")[0] for x in schema.split(", ")]
    return docs.select(*columns, F.col(text_col).alias("t")).mapInArrow(run, schema)


def decode(ids: list[int], rules: Merges) -> str:
    """The ids' bytes as UTF-8; what is not UTF-8 becomes U+FFFD."""
    return b"".join(map(rules.bytes.__getitem__, ids)).decode("utf-8", "replace")


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", lexicon_words: int = LEXICON_WORDS) -> DataFrame:
    """(doc_id, ids array, n_tokens) per row of docs. A null text is empty and has no ids; special tokens in a text get their ids; rows that repeat stay; a null id stays null."""
    return _encoded(docs, [F.col(id_col).cast("long").alias("doc_id")], "doc_id long, ids array<int>, n_tokens long", text_col, tokenizer, lexicon_words, False)


def encode_digests(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", lexicon_words: int = LEXICON_WORDS) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) per row of docs: its ids in decimal, joined by commas, and the text that they decode to."""
    return _encoded(docs, [F.col(id_col).cast("long").alias("doc_id")], "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", text_col, tokenizer, lexicon_words, True)
