"""Exact token counts of every prefix of a text, from a dynamic programme over its pieces."""

from __future__ import annotations

import bisect
import re
from array import array
from collections.abc import Iterable, Iterator
from itertools import accumulate, chain, pairwise
from operator import sub

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm.common import sliced, table

#: Counters of this process by model, so that tasks share what is learnt.
_COUNTERS: dict[str, PrefixCounter] = {}
#: Distinct stretches whose counts a task keeps, or those of one slice; beyond it the store starts anew.
MEMO = 400_000
#: Last characters of a prefix by which the pieces that it may end with are looked up.
TAIL = 4
#: Stretches of a text that has a space set in front: spaces and a word, a line feed and a word,
#: or spaces alone. No piece of a vocabulary whose space mark only opens pieces, and which has no
#: line feed in a piece, crosses their borders, so counts add up over stretches.
STRETCH = re.compile(r" *[^ \n]+|\n[^ \n]*| +")


class PrefixCounter:
    """Token counts of prefixes under one sentencepiece model.

    With the marked text cut into stretches s1, s2, ..., the programme is
    count(0) = 0, count(end of s_i) = count(end of s_(i-1)) + tokens(s_i), and inside s_i
    count(end of s_(i-1) + j) = count(end of s_(i-1)) + tokens(s_i[:j]).
    A stretch is stored without its first space, since the library sets that mark itself.
    """

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        spec = pb.ModelProto()
        with open(path, "rb") as f:
            spec.ParseFromString(f.read())
        norm = spec.normalizer_spec
        mark = "▁"
        self.plain = (
            norm.name == "identity"
            and not norm.precompiled_charsmap
            and not norm.remove_extra_whitespaces
            and norm.add_dummy_prefix
            and not spec.trainer_spec.treat_whitespace_as_suffix
            and not any(mark in p.piece.lstrip(mark) or "\n" in p.piece or p.type == 4 for p in spec.pieces)
        )
        self.memo: dict[str, int] = {}
        self.inners: dict[str, array] = {}
        #: Of learnt stretches the changes of the count from prefix to prefix, as 32-bit numbers; see _changed().
        self.changed: dict[str, bytes] = {}
        # For a BPE model: the piece that a prefix ends with is the one piece that the piece before
        # it doesn't merge with, so its count follows from the one of a shorter prefix.
        kinds = {p.type for p in spec.pieces}
        self.steps = self.plain and spec.trainer_spec.model_type == 2 and 5 not in kinds
        self.pieces = {p.piece for p in spec.pieces if p.type == 1}
        # sizes of the pieces of over four characters by their last four
        self.longer: dict[str, set[int]] = {}
        for piece in self.pieces:
            if len(piece) > TAIL:
                self.longer.setdefault(piece[-TAIL:], set()).add(len(piece))
        #: Sizes that a piece may have that ends with these characters, longest first; see _ending().
        self.sizes: dict[str, tuple[int, ...]] = {}
        #: The last key of the programme, the piece that each of its prefixes ends with, and their counts.
        self.walked: tuple[str, list[str], list[int]] = ("", [""], [0])
        self.bytes = spec.trainer_spec.byte_fallback
        spec.normalizer_spec.add_dummy_prefix = False
        self.bare = sentencepiece.SentencePieceProcessor(model_proto=spec.SerializeToString())
        self.pairs: dict[tuple[str, str], bool] = {}

    def _apart(self, a: str, b: str) -> bool:
        """Whether pieces a and b (a may be empty) stay as they are next to each other."""
        found = self.pairs.get((a, b))
        if found is None:
            if len(self.pairs) > MEMO:
                self.pairs = {}
            # two neighbours that make up a piece are always merged
            found = self.pairs[a, b] = not (a and a + b in self.pieces) and self.bare.encode(a + b, out_type=str) == ([a, b] if a else [b])
        return found

    def _ending(self, tail: str) -> tuple[int, ...]:
        """Sizes of the pieces that a text may end with whose last characters are ``tail``, of TAIL
        characters or a shorter text's all: longer sizes are possible, others certain. None, if its last
        character is no piece."""
        if len(self.sizes) > MEMO:
            self.sizes = {}
        known = tail[-1] in self.pieces
        short = [n for n in range(len(tail), 0, -1) if tail[-n:] in self.pieces]
        found = self.sizes[tail] = (*sorted(self.longer.get(tail, ()), reverse=True), *short) if known else ()
        return found

    def _programme(self, key: str) -> list[int] | None:
        """Tokens of ``key[:j]`` with the library's mark in front, for j from 0 on, each from the count of a
        shorter prefix and the piece that it ends with; None where the programme finds no such piece. What
        a key shares with the one before it stays, so sorted keys take the fewest steps."""
        if not self.steps:
            return None
        (before, last, counts), text = self.walked, ("▁" + key).replace(" ", "▁")
        n, most = 0, min(len(before), len(text), len(last) - 1)
        while n < most and before[n] == text[n]:
            n += 1
        del last[n + 1 :], counts[n + 1 :]
        self.walked = text, last, counts
        pieces, known = self.pieces, self.sizes.get
        for i in range(n + 1, len(text) + 1):
            tail = text[i - TAIL : i] if i > TAIL else text[:i]
            sizes = known(tail)
            if sizes is None:
                sizes = self._ending(tail)
                known = self.sizes.get
            if not sizes:
                c = text[i - 1]
                last.append("")
                counts.append(counts[-1] + (len(c.encode()) if self.bytes else i < 2 or text[i - 2] in pieces))
                continue
            for size in sizes:
                j = i - size
                if j < 0:
                    continue
                piece = text[j:i]
                if size > TAIL and piece not in pieces:
                    continue
                apart = self.pairs.get((last[j], piece))
                if self._apart(last[j], piece) if apart is None else apart:
                    last.append(piece)
                    counts.append(counts[j] + 1)
                    break
            else:
                return None
        return counts[1:]

    def _inner(self, key: str, total: int) -> array:
        """The programme's counts of ``key[:j]``; ``total`` is the library's count of the whole, and what
        they have to end at, else the library encodes every prefix."""
        found = self._programme(key)
        if found and found[-1] == total:
            return array("i", found)
        return array("i", [1, *(len(x) for x in self.sp.encode([key[:j] for j in range(1, len(key))], num_threads=1)), total])

    def _learn(self, stretches: Iterable[str]) -> None:
        new = set(stretches).difference(self.memo)
        if not new:
            return
        if len(self.memo) + len(new) > MEMO:
            self.memo, self.changed, new = {}, {}, set(stretches)
        keys = sorted(new)
        for key, ids in zip(keys, self.sp.encode(keys, num_threads=1), strict=True):
            # the programme counts, the library's count of the whole is the check that follows; the
            # library's mark before a line feed is no part of the stretch; alone it is a token
            self.memo[key] = (self._ended(key, len(ids)) - (key[:1] == "\n")) if key else 1

    def _ended(self, key: str, total: int) -> int:
        """The programme's count at the end of a stretch: the last entry of its prefix counts, whose changes are kept."""
        found = self._programme(key)
        if not found or found[-1] != total:
            return total
        self.changed[key] = self._changes(key, found)
        return found[-1]

    @staticmethod
    def _changes(key: str, inner: list[int] | array) -> bytes:
        """Changes of the count at the space of a stretch and at each of its characters, from the counts of
        ``key[:j]`` behind the library's mark; one that opens with a line feed has no space."""
        found = array("i", map(sub, inner, [0, *inner]))
        return (found[1:] if key[:1] == "\n" else found).tobytes()

    def _changed(self, key: str) -> bytes:
        found = self.changed.get(key)
        if found is None:
            feed = key[:1] == "\n"
            found = self.changed[key] = self._changes(key, self._inner(key, self.memo[key] + feed) if key else [1])
        return found

    def inside(self, key: str) -> array:
        """Tokens up to every code point of a learnt stretch; worked out when first asked for."""
        found = self.inners.get(key)
        if found is None:
            if len(self.inners) > MEMO:
                self.inners = {}
            feed = key[:1] == "\n"
            found = self._inner(key, self.memo[key] + feed) if key else array("i", [1])
            found = self.inners[key] = array("i", [x - 1 for x in found]) if feed else found
        return found

    def stretches(self, text: str) -> list[str]:
        """The stretches of a text without their first spaces, learnt."""
        keys = self.keys(text)
        self._learn(keys)
        return keys

    def tables(self, texts: list[str]) -> list[tuple[list[int], list[int]]]:
        """The prefix table of each text in compact form: characters and tokens of each stretch in turn. Their
        running sums are prefixes(), the lengths of the prefixes that end at a stretch and their exact counts.
        The stretches of all texts are learnt at once, so that the programme runs over more of them in
        order, which share more."""
        return [self._table(own) for own in self.learnt(texts)]

    def learnt(self, texts: list[str]) -> list[list[str]]:
        """The stretches of each text, learnt all at once."""
        keys = [self.keys(text) for text in texts]
        self._learn(set().union(*keys))
        return keys

    def columns(self, texts: list[str]) -> tuple[np.ndarray, ...]:
        """Of all texts together: characters and tokens of each stretch (the prefix tables), by how much each code
        point changes the count of its prefix, and the ends of each text in the tables and in the changes. Running
        sums of a text's changes are the exact counts of all its prefixes."""
        keys = self.learnt(texts)
        every = list(chain.from_iterable(keys))
        for key in set(every).difference(self.changed):
            self._changed(key)
        parts = list(map(self.changed.__getitem__, every))
        changes = np.frombuffer(b"".join(parts), np.int32)
        chars = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        ends = np.cumsum([0, *map(len, keys)])
        starts = np.concatenate(([0], np.cumsum(chars)))
        if not len(parts):
            return chars, chars, changes, ends, ends
        tokens = np.add.reduceat(changes, starts[:-1])
        # the mark that the library sets in front belongs to the first character
        first = ends[:-1][np.diff(ends) > 0]
        changes = changes.copy()
        changes[starts[first] + 1] += changes[starts[first]]
        kept = np.ones(len(changes), bool)
        kept[starts[first]] = False
        chars[first] -= 1
        alone = first[chars[first] == 0]  # texts that open with a line feed
        tokens[alone + 1] += tokens[alone]
        shown = np.ones(len(chars), bool)
        shown[alone] = False
        at = starts[ends] - np.concatenate(([0], np.cumsum(np.diff(ends) > 0)))
        return chars[shown], tokens[shown], changes[kept], np.concatenate(([0], np.cumsum(shown)))[ends], at

    def _table(self, keys: list[str]) -> tuple[list[int], list[int]]:
        chars = [len(key) + 1 - key.startswith("\n") for key in keys]
        tokens = list(map(self.memo.__getitem__, keys))
        if keys and keys[0][:1] != "\n":
            chars[0] -= 1
        if chars[:1] == [0]:  # a text that opens with a line feed has its mark alone
            return chars[1:], [sum(tokens[:2]), *tokens[2:]] if chars[1:] else []
        return chars, tokens

    @staticmethod
    def keys(text: str) -> list[str]:
        """The stretches of a text without their first spaces."""
        if "▁" in text:
            text = text.replace("▁", " ")
        if "  " in text or text[:1] == " ":
            return [s[1:] if s[0] == " " else s for s in STRETCH.findall(" " + text)]
        return text.replace("\n", " \n").split(" ") if text else []

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each whole text."""
        return [n for n, _ in self.cut(texts, None)]

    def cut(self, texts: list[str], limit: int | None) -> list[tuple[int, int]]:
        """Of each text the tokens, the last entry of its table, and the length of its longest
        prefix of at most ``limit`` tokens (all of it without a limit). A model that isn't
        ``plain`` has no table: the library counts whole texts, and the length is 0 or all."""
        if not self.plain:
            return [(n, len(t) if limit is None or n <= limit else 0) for t, n in zip(texts, map(len, self.sp.encode(texts, num_threads=1)), strict=True)]
        out = []
        for text in texts:
            keys = self.stretches(text)
            sums = list(accumulate(map(self.memo.__getitem__, keys)))
            total = sums[-1] if sums else 0
            kept = len(text)
            if limit is not None and total > limit:
                # every stretch has a token, so only the first one that ends beyond the limit can be cut
                n = bisect.bisect_right(sums, limit)
                whole, before = self.prefixes(text, False, keys[:n])[0][-1], sums[n - 1] if n else 0
                space = n > 0 and keys[n][:1] != "\n"
                first = 0 if space else 1
                inner = [(whole + j + space, before + c) for j, c in enumerate(self.inside(keys[n])) if j >= first]
                kept = max([whole, *(e for e, c in inner if c <= limit)])
            out.append((total, kept))
        return out

    def prefixes(self, text: str, inside: bool = False, keys: list[str] | None = None) -> tuple[list[int], list[int]]:
        """Prefix lengths in code points and their exact token counts: at the end of every
        stretch, and with ``inside`` at every code point; of the first stretches ``keys`` only, if
        given. Needs a ``plain`` model."""
        if not self.plain:
            raise ValueError("this model's normaliser moves characters; its prefixes can't be added up")
        keys = self.stretches(text) if keys is None else keys
        if not inside:
            sizes = [len(key) + (key[:1] != "\n") for key in keys]
            if keys and keys[0][:1] != "\n":
                sizes[0] -= 1
            ends, counts = [0, *accumulate(sizes)], [0, *accumulate(map(self.memo.__getitem__, keys))]
            return (ends[:1] + ends[2:], counts[:1] + counts[2:]) if ends[1:2] == [0] else (ends, counts)
        ends, counts, at, total = [0], [0], 0, 0
        for n, key in enumerate(keys):
            inner = self.inside(key)
            # a stretch is its space and its key, but one that opens with a line feed has no space
            feed = key[:1] == "\n"
            first = 1 if feed or n == 0 else 0
            for j in range(first, len(key) + 1):
                ends.append(at + j + (0 if feed or n == 0 else 1))
                counts.append(total + inner[j])
            at, total = at + len(key) + (0 if feed or n == 0 else 1), total + self.memo[key]
        if len(ends) > 1 and ends[1] == 0:  # a text that opens with a line feed has its mark alone
            ends, counts = ends[:1] + ends[2:], counts[:1] + counts[2:]
        return ends, counts


def counter_of(path: str) -> PrefixCounter:
    """The counter of a model in this process, made when first asked for."""
    if path not in _COUNTERS:
        _COUNTERS[path] = PrefixCounter(path)
    return _COUNTERS[path]


def steps(counts: list[int]) -> list[int]:
    """Changes from prefix to prefix of the counts at every code point."""
    return [b - a for a, b in pairwise(counts)]


def unpacked(changes: list[int]) -> tuple[list[int], list[int]]:
    """Lengths and counts of every prefix, from steps()."""
    return list(range(len(changes) + 1)), [0, *accumulate(changes)]


def within(ends: list[int], counts: list[int], budget: int) -> int:
    """Length of the longest stored prefix of at most ``budget`` tokens, without encoding."""
    good = [e for e, c in zip(ends, counts, strict=True) if c <= budget]
    return max(good, default=0)


def at_length(ends: list[int], counts: list[int], length: int) -> int:
    """Token count of the last stored prefix that is not longer than ``length``."""
    return counts[bisect.bisect_right(ends, length) - 1]


def _within(changes: np.ndarray, limit: int) -> int:
    """Length of the longest prefix of at most ``limit`` tokens, from the changes at every code point."""
    return int(np.flatnonzero(np.cumsum(changes) <= limit).max(initial=-1)) + 1


def _lists(ends: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int32()))


def count_tokens(docs: DataFrame, path: str, limit: int = 4096, keep_prefixes: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, kept_chars, chars, tokens of each row.

    ``chars`` and ``tokens`` are the prefix table (see ``PrefixCounter.tables``), n_tokens its last entry,
    kept_chars the longest prefix of at most ``limit`` tokens, looked up in the table and, inside
    the stretch that crosses the limit, worked out character by character; over_limit means that
    it isn't the whole text. With ``keep_prefixes`` also steps, by how much each code point changes
    the count (unpacked() gives every prefix), from which kept_chars is then read.

    Null and empty texts have 0 bytes and tokens and an empty table. Rows are independent: repeated
    rows give repeated results, no rows give none, other columns are ignored. Texts are read whole,
    however long. Tasks hold a slice of one Arrow batch as objects and at most MEMO stretches. A
    model that isn't ``plain`` has whole counts only: its tables are null and kept_chars 0 or all.
    """
    schema = "doc_id long, n_bytes long, n_tokens long, over_limit boolean, kept_chars long, chars array<int>, tokens array<int>" + ", steps array<int>" * keep_prefixes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(path)
        if keep_prefixes and not counter.plain:
            raise ValueError("this model's normaliser moves characters; its prefixes can't be added up")
        for batch in sliced(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            if keep_prefixes:
                chars, tokens, changes, ends, at = counter.columns(texts)
                sums = np.concatenate(([0], np.cumsum(tokens)))
                totals = np.diff(sums[ends])
                kept = [len(t) if n <= limit else _within(changes[a:b], limit) for t, n, a, b in zip(texts, totals.tolist(), at[:-1].tolist(), at[1:].tolist(), strict=True)]
                lists = [_lists(ends, chars), _lists(ends, tokens), _lists(at, changes)]
            elif counter.plain:
                tables = counter.tables(texts)
                totals = [sum(tokens) for _, tokens in tables]
                kept = [len(t) if n <= limit else counter.cut([t], limit)[0][1] for t, n in zip(texts, totals, strict=True)]
            else:
                tables = [(None, None)] * len(texts)
                totals, kept = zip(*counter.cut(texts, limit), strict=True) if texts else ((), ())
            if not keep_prefixes:
                lists = [pa.array([x[i] for x in tables], pa.list_(pa.int32())) for i in (0, 1)]
            cols = [
                batch.column(0).cast(pa.int64()),
                pa.array([len(t.encode()) for t in texts], pa.int64()),
                pa.array(totals, pa.int64()),
                pa.array([k < len(t) for t, k in zip(texts, kept, strict=True)], pa.bool_()),
                pa.array(kept, pa.int64()),
                *lists,
            ]
            names = ["doc_id", "n_bytes", "n_tokens", "over_limit", "kept_chars", "chars", "tokens", "steps"]
            yield pa.RecordBatch.from_arrays(cols, names[: len(cols)])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), keep_prefixes=True)
