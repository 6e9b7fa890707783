"""Token counts through prefix tables.

A prefix table holds the exact number of tokens of every prefix of a text. It is made by dynamic
programming: the tokens of a run (what the tokenizer never joins across) cut after position i end with
the one token whose pair with the last token of what stands before it survives the tokenizer's merges, so

    count(i) = count(i - length of that token) + 1

Totals, truncation points and the cost of any prefix are read from tables; no prefix is encoded again.
Each distinct run's table is made once in a worker.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_texts

#: Pieces and runs that a worker remembers; beyond them it starts anew (speed only).
CACHE = 700_000
#: Letters with more marks than this are counted by blocks of marks.
FEW_MARKS = 12
_SPACES = re.compile(r"[^\x20\x09-\x0D]+")
_CONTRACTIONS = ("'re", "'ve", "'ll")
_NEVER = 1 << 60


class PrefixTables:
    """Exact token counts of all prefixes, for byte-level BPE whose runs never depend on white space.

    The tokenizer's normaliser and pre-tokeniser are the library's own; what they may be made of is
    checked, because a table is only right where a prefix's runs are the text's runs, the last one cut.
    """

    def __init__(self, tokenizer_json: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        spec = json.loads(tokenizer_json)
        self._check(spec)
        tokenizer = Tokenizer.from_str(tokenizer_json)
        self.normalize, self.split_runs = tokenizer.normalizer.normalize_str, tokenizer.pre_tokenizer.pre_tokenize_str
        specials = sorted((a["content"] for a in spec["added_tokens"]), key=len, reverse=True)
        self.specials = re.compile("|".join(map(re.escape, specials))) if specials else None
        model, suffix = spec["model"], spec["model"]["end_of_word_suffix"]
        vocab = {s: t + 1 for s, t in model["vocab"].items()}  # 0 stands for no token
        self.size = max(vocab.values()) + 1
        self.left, self.right, self.rank = {}, {}, {}
        self.made = dict.fromkeys(vocab.values(), -1)
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            whole = vocab[a + b]
            self.rank[vocab[a] * self.size + vocab[b]] = rank
            self.left[whole], self.right[whole], self.made[whole] = vocab[a], vocab[b], rank
        whole = lambda t: self.made[t] < 0 or self._reached(t)
        inner = {s: t for s, t in vocab.items() if not s.endswith(suffix) and whole(t)}
        closing = {s[: -len(suffix)]: t for s, t in vocab.items() if s.endswith(suffix) and whole(t)}
        #: letters -> (token inside a run, token that closes it); 0 where there is none
        self.tokens = {s: (inner.get(s, 0), closing.get(s, 0)) for s in (*inner, *closing)}
        self.longest = max(map(len, self.tokens))
        self.ascii_runs = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\x09-\x0D\x20a-z0-9]+")
        self.pairs: dict[int, bool] = {}
        self.runs: dict[str, list[int]] = {}
        self.totals: dict[str, int] = {}
        self.pieces: dict[bytes, int] = {}
        self.of_letter: dict[str, str] = {}

    @staticmethod
    def _check(spec: dict) -> None:
        many = lambda x, key: x[key] if x and x["type"] == "Sequence" else [x]
        normalisers = many(spec["normalizer"], "normalizers")
        first, *rest = many(spec["pre_tokenizer"], "pretokenizers")
        model = spec["model"]
        runs = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"  # the tokenizer's, as it must be
        good = (
            [n and n["type"] for n in normalisers] == ["NFC", "Replace", "Lowercase"] and normalisers[1]["pattern"] == {"Regex": r"\s+"} and normalisers[1]["content"] == " "
            and first and first["type"] == "Split" and first["pattern"] == {"Regex": runs} and first["behavior"] == "Removed" and first["invert"]
            and [(p["type"], p["add_prefix_space"], p["use_regex"]) for p in rest] == [("ByteLevel", False, False)]
            and model["type"] == "BPE" and model["end_of_word_suffix"] and not (model["dropout"] or model["unk_token"] or model["continuing_subword_prefix"] or model["ignore_merges"] or model["byte_fallback"])
            and not any(a["lstrip"] or a["rstrip"] or a["single_word"] or a["normalized"] for a in spec["added_tokens"])
        )
        if not good:
            raise ValueError("prefix tables need byte-level BPE with word ends and runs that do not depend on white space")

    def _reached(self, token: int) -> bool:
        """The token's own letters are merged to it: its halves' borders survive until it is made."""
        rank = self.made[token]
        return self.made[self.left[token]] < rank and self.made[self.right[token]] < rank and self._survives(self.left[token], self.right[token], rank)

    def _survives(self, a: int, b: int, until: int = _NEVER) -> bool:
        """No merge before ``until`` crosses the border of neighbours a, b: walks back through what stood at the border.

        x and y are alive from the merges that made them to those (before_x, before_y) that used them up.
        Of equal merges the left one comes first.
        """
        x, y, before_x, before_y = a, b, until, until - 1
        while True:
            rank = self.rank.get(x * self.size + y)
            if rank is not None and rank < before_x and rank <= before_y:
                return False
            made_x, made_y = self.made[x], self.made[y]
            if made_x < 0 and made_y < 0:
                return True
            if made_x > made_y:
                before_x, x = made_x, self.right[x]
            else:
                before_y, y = made_y, self.left[y]

    def _stable(self, a: int, b: int) -> bool:
        key = a * self.size + b
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) > 4 * CACHE:
                self.pairs.clear()
            found = self.pairs[key] = self._survives(a, b)
        return found

    def _grown(self, run: str, begin: int, last: list[int], count: list[int], whole: bool = True, first_closed: int = 1) -> list[int]:
        """Closed counts of the run's prefixes longer than ``begin``; last and count (open ends) grow with them.

        They hold an entry for each prefix up to ``begin``; ``whole`` tells that index 0 is the run's start.
        Prefixes shorter than first_closed get only their open end, from which the longer ones follow.
        """
        tokens, longest, size, pairs, table = self.tokens, self.longest, self.size, self.pairs, []
        shifted = [t * size for t in last]
        for end in range(begin + 1, len(run) + 1):
            open_end = closed = 0
            close = end >= first_closed
            for start in range(end - longest if end > longest else 0, end):
                found = tokens.get(run[start:end])
                if found is None:
                    continue
                t, closing = found
                if whole and not start:
                    open_end, closed, new = t and 1, closing and 1, t
                else:
                    at = shifted[start]
                    if t and not open_end:
                        ok = pairs.get(at + t)
                        if self._stable(last[start], t) if ok is None else ok:
                            open_end, new = count[start] + 1, t
                    if close and closing and not closed:
                        ok = pairs.get(at + closing)
                        if self._stable(last[start], closing) if ok is None else ok:
                            closed = count[start] + 1
                if open_end and (closed or not close):
                    break
            last.append(new)
            shifted.append(new * size)
            count.append(open_end)
            if close:
                table.append(closed)
        return table

    def run_total(self, run: str) -> int:
        """Tokens of a whole run: the last entry of its table, made without the closed counts before it."""
        n = self.totals.get(run)
        if n is None:
            if len(self.totals) > CACHE:
                self.totals.clear()
            n = self.totals[run] = self._grown(run, 0, [0], [0], True, len(run))[-1]
        return n

    def run_table(self, run: str) -> list[int]:
        """Token counts of the prefixes of a run (byte letters), each closed as a word; the first is for one letter."""
        table = self.runs.get(run)
        if table is None:
            table = self._grown(run, 0, [0], [0])
            if run in _CONTRACTIONS:  # cut before its end, it is an apostrophe and a letter
                table[1] = self.run_total(run[0]) + self.run_total(run[1])
            if len(self.runs) > CACHE // 10:
                self.runs.clear()
            self.runs[run] = table
        return table

    def _normal_runs(self, piece: str):
        """(normalised text, [(byte letters, start, end in it)]) of a piece without special strings."""
        if piece.isascii() and piece.isprintable():  # here the library's steps come to this
            low = piece.lower()
            return low, [(m[0], m.start(), m.end()) for m in self.ascii_runs.finditer(low)]
        low = self.normalize(piece)
        return low, self._runs_of(low)

    def _runs_of(self, low: str) -> list[tuple[str, int, int]]:
        """Runs of a normalised text; to normalise it again might order its marks anew (a lower-cased letter may bring one)."""
        return [(run, *place) for run, place in self.split_runs(low)]

    def _plain_total(self, piece: str) -> int:
        return sum(self.run_total(run) for run, _, _ in self._normal_runs(piece)[1])

    def _normal_table(self, low: str, runs: list) -> list[int]:
        """Token counts of the prefixes of a normalised text, one for each code point."""
        out, base, at = [], 0, 0
        for run, start, end in runs:
            out += [base] * (start - at)
            table, place = self.run_table(run), -1
            for c in low[start:end]:
                place += 1 if c < "\x80" else len(c.encode())
                out.append(base + table[place])
            base += table[-1]
            at = end
        return out + [base] * (len(low) - at)

    def _plain_table(self, piece: str) -> list[int]:
        low, runs = self._normal_runs(piece)
        out = self._normal_table(low, runs)
        if low.isascii() and len(low) == len(piece):
            return out
        parts = [self._letter(c) for c in piece]
        if "".join(parts) != low:
            return self._uneven_table(piece, low, runs, out)
        return [out[k - 1] for k in np.cumsum([len(p) for p in parts]).tolist()]

    def _letter(self, c: str) -> str:
        low = self.of_letter.get(c)
        if low is None:
            low = self.of_letter[c] = self.normalize(c)
        return low

    def _uneven_table(self, piece: str, low: str, runs: list, table: list[int]) -> list[int]:
        """Where letters combine: at clusters' ends the table's own counts, inside them those of what the cut leaves."""
        out, at, k, states = [], 0, -1, None
        starts = [start for _, start, _ in runs]

        def behind(tail: str) -> tuple[int, str]:
            """Tokens of the text before the cluster with ``tail`` behind it, and the letters of its last run."""
            nonlocal k, states
            run = bisect_left(starts, at) - 1  # the run behind which the cluster stands
            if run < 0 or runs[run][2] < at:
                parts = self._runs_of(tail)
                return (table[at - 1] if at else 0) + sum(self.run_total(r) for r, _, _ in parts), parts[-1][0] if parts else ""
            letters, start, _ = runs[run]
            near = max(start, at - 4)  # enough to tell what the runs are
            parts = self._runs_of(low[near:at] + tail)
            n = (table[start - 1] if start else 0) + sum(self.run_total(r) for r, _, _ in parts[1:])
            if near == start:
                return n + self.run_total(parts[0][0]), parts[-1][0]
            if run != k:
                k, states = run, ([0], [0])
                self._grown(letters, 0, *states)
            done = len(low[start:at].encode())
            more = parts[0][0][len(low[near:at].encode()) :]
            since = max(0, done - self.longest)
            closed = self._grown(letters[since:done] + more, done - since, states[0][since : done + 1], states[1][since : done + 1], not since)
            n += closed[-1] if more else self.run_table(letters)[done - 1]
            return n, letters[:done] + more if len(parts) == 1 else parts[-1][0]

        begin = 0
        while begin < len(piece):
            end = begin + 1
            while end < len(piece) and (unicodedata.combining(piece[end]) or self.normalize(piece[begin : end + 1]) != self.normalize(piece[begin:end]) + self._letter(piece[end])):
                end += 1
            cluster = piece[begin:end]
            inside = Cluster(self, cluster, behind).counts() if len(cluster) > FEW_MARKS else None
            out += inside if inside is not None else [behind(self.normalize(cluster[:cut]))[0] for cut in range(1, len(cluster))]
            at += len(self.normalize(cluster))
            out.append(table[at - 1])
            begin = end
        return out

    def piece_table(self, piece: str) -> list[int]:
        """Token counts of the prefixes of a piece without ASCII white space, one for each code point."""
        out, base, at = [], 0, 0
        for m in self.specials.finditer(piece) if self.specials else ():
            # until it is complete, a special string is ordinary text behind what precedes it
            out += [base + n for n in self._plain_table(piece[at : m.end() - 1])]
            base += (self._plain_total(piece[at : m.start()]) if m.start() > at else 0) + 1
            out.append(base)
            at = m.end()
        return out + ([base + n for n in self._plain_table(piece[at:])] if at < len(piece) else [])

    def total(self, piece: bytes) -> int:
        """Tokens of a whole piece: the last entry of its tables."""
        n = self.pieces.get(piece)
        if n is None:
            text = piece.decode()
            parts = self.specials.split(text) if self.specials else [text]
            n = len(parts) - 1 + sum(self._plain_total(p) for p in parts if p)
            if len(self.pieces) > CACHE:
                self.pieces.clear()
            self.pieces[piece] = n
        return n

    def text_table(self, text: str) -> np.ndarray:
        """Token counts of the prefixes of a text, one for each code point."""
        out, base = np.zeros(len(text), np.int32), 0
        at = 0
        for m in _SPACES.finditer(text):
            out[at : m.start()] = base
            table = self.piece_table(m[0])
            out[m.start() : m.end()] = table
            out[m.start() : m.end()] += base
            base += table[-1]
            at = m.end()
        out[at:] = base
        return out


class Block:
    """Letters of a run that grow at their end, with the last token and the tokens so far behind each.

    Counts from ``since`` on are stored without ``more``, so that all of them change at once.
    """

    def __init__(self):
        self.letters, self.last, self.stored, self.since, self.more = [], [], [], 0, 0

    def count(self, i: int) -> int:
        return self.stored[i] + (self.more if i >= self.since else 0)

    def put(self, i: int, last: int, count: int) -> None:
        self.last[i], self.stored[i] = last, count - (self.more if i >= self.since else 0)


class Cluster:
    """Counts of the prefixes of a letter and its marks, which a normal form orders by class and combines.

    The marks of one class keep their order, so the last run of a prefix is made of blocks that only grow at their
    ends: one for what stands before the marks, and one for each class. A mark changes its own block's end, and
    in the blocks behind it as many states as differ until they follow from equal ones. The first marks of each
    class tell which of them the letter takes up. What is composed this way is compared with the library's
    normal form; where Unicode's tables differ, ``counts`` is None and each prefix is counted by itself.
    """

    #: No letter takes up more marks of a class.
    TAKEN = 8

    def __init__(self, tables: PrefixTables, cluster: str, behind):
        self.tables, self.cluster, self.behind = tables, cluster, behind
        self.span = tables.longest
        plain = unicodedata.normalize("NFD", cluster[0])
        n = max((i + 1 for i, c in enumerate(plain) if not unicodedata.combining(c)), default=0)
        self.base, self.marks = plain[:n], {}
        for c in plain[n:]:
            self.marks.setdefault(unicodedata.combining(c), []).append(c)
        self.blocks, self.head, self.of_mark = None, None, {}

    def counts(self) -> list[int] | None:
        out = []
        for k in range(1, len(self.cluster)):
            if k > 1 and not self._added(self.cluster[k - 1]):
                return None
            if k & (k - 1) == 0 and self._composed() != self.tables.normalize(self.cluster[:k]):
                return None
            out.append(self._count(k))
        return out if self._added(self.cluster[-1]) and self._composed() == self.tables.normalize(self.cluster) else None

    def _letters(self, mark: str) -> str | None:
        """A mark as the run's letters; None for one that is no mark of the tokenizer's."""
        found = self.of_mark.get(mark)
        if found is None:
            parts = self.tables._normal_runs(mark)[1]
            found = self.of_mark[mark] = parts[0][0] if len(parts) == 1 and self.tables._letter(mark) == mark else ""
        return found or None

    def _taken(self) -> tuple[str, dict[int, int]]:
        """The letter with what it takes up, and how many marks of each class that are."""
        few = {c: self.marks[c][: self.TAKEN] for c in sorted(self.marks)}
        form = unicodedata.normalize("NFC", self.base + "".join("".join(m) for m in few.values()))
        n = next((i for i, c in enumerate(form) if unicodedata.combining(c)), len(form))
        left = [unicodedata.combining(c) for c in form[n:]]
        return "".join(map(self.tables._letter, form[:n])), {c: len(m) - left.count(c) for c, m in few.items()}

    def _composed(self) -> str:
        head, taken = self._taken()
        return head + "".join("".join(self.marks[c][taken[c] :]) for c in sorted(self.marks))

    def _added(self, mark: str) -> bool:
        for c in unicodedata.normalize("NFD", mark):
            group = unicodedata.combining(c)
            letters = self._letters(c)
            if not group or not letters:
                return False
            self.marks.setdefault(group, []).append(c)
            if len(self.marks[group]) <= self.TAKEN:
                self.blocks = None if self._taken() != self.head else self.blocks
            if self.blocks is not None:
                self._insert(group, letters)
        return True

    def _count(self, k: int) -> int:
        if self.blocks is None:
            self.head = self._taken()
            head, taken = self.head
            left = {c: self.marks[c][taken[c] :] for c in sorted(self.marks) if len(self.marks[c]) > taken[c]}
            if not left:
                return self.behind(head)[0]
            first = next(iter(left.values()))[0]
            n, run = self.behind(head + first)
            before = run[: len(run) - len(self._letters(first))]
            self.blocks = {-1: Block()}
            self._grow(-1, before)
            for c, marks in left.items():
                self._grow(c, "".join(map(self._letters, marks)))
            self.rest = n - self.tables.run_total(run)
        return self.rest + self._closed()

    def _context(self, order: list[int]) -> tuple[list[str], list[int], list[int], bool]:
        """The last letters of some blocks with the states around them; whether they reach back to the run's start."""
        letters, last, count = [], [], []
        for c in reversed(order):
            block = self.blocks[c]
            lo = max(0, len(block.letters) - (self.span + 1 - len(letters)))
            letters[:0], last[:0] = block.letters[lo:], block.last[lo:]
            count[:0] = [block.count(i) for i in range(lo, len(block.letters))]
            if len(letters) > self.span:
                return letters[1:], last, count, False
        return letters, [0, *last], [0, *count], True

    def _grow(self, group: int, letters: str) -> None:
        """Letters more at a block's end; the blocks behind it are left as they are."""
        block = self.blocks.get(group)
        if block is None:
            block = self.blocks[group] = Block()
            self.blocks = dict(sorted(self.blocks.items()))
        before, last, count, whole = self._context([c for c in self.blocks if c <= group])
        run = "".join(before) + letters
        self.tables._grown(run, len(before), last, count, whole, len(run) + 1)
        for i in range(len(letters)):
            block.letters.append(letters[i])
            block.last.append(0)
            block.stored.append(0)
            block.put(len(block.letters) - 1, last[len(before) + 1 + i], count[len(before) + 1 + i])

    def _insert(self, group: int, letters: str) -> None:
        self._grow(group, letters)
        for c in [c for c in self.blocks if c > group]:
            self._follow(c)

    def _follow(self, group: int) -> None:
        """A block behind other states: its own are made anew until ``span`` of them differ by one number only."""
        block, at, same, by = self.blocks[group], 0, 0, None
        before, last, count, whole = self._context([c for c in self.blocks if c < group])
        while at < len(block.letters) and same < self.span:
            part = block.letters[at : at + self.span]
            run = "".join(before) + "".join(part)
            self.tables._grown(run, len(before), last, count, whole, len(run) + 1)
            for i in range(len(part)):
                new_last, new_count = last[len(before) + 1 + i], count[len(before) + 1 + i]
                apart = new_count - block.count(at + i)
                same = same + 1 if block.last[at + i] == new_last and apart == by else int(block.last[at + i] == new_last)
                by = apart
                block.put(at + i, new_last, new_count)
            at += len(part)
            before = [*before, *part]
            if len(before) > self.span:
                cut = len(before) - self.span
                before, last, count, whole = before[cut:], last[cut:], count[cut:], False
        if at < len(block.letters) and by:
            for i in range(at, block.since):
                block.stored[i] += by
            for i in range(block.since, at):
                block.stored[i] += block.more
            block.since = max(block.since, at)
            block.more += by

    def _closed(self) -> int:
        """Tokens of the whole run, its end closed."""
        letters, last, count, whole = self._context(list(self.blocks))
        return self.tables._grown("".join(letters), len(letters) - 1, last[:-1], count[:-1], whole, len(letters))[-1]


_tables: dict[str, PrefixTables] = {}


def prefix_tables(tokenizer_json: str) -> PrefixTables:
    """The worker's tables of a tokenizer."""
    if tokenizer_json not in _tables:
        _tables[tokenizer_json] = PrefixTables(tokenizer_json)
    return _tables[tokenizer_json]


def _cut(tables: PrefixTables, text: bytes, sums: np.ndarray, limit: int) -> int:
    """Bytes of the longest prefix of at most ``limit`` tokens, for a text of more."""
    k = int(np.searchsorted(sums, limit, "right"))  # the piece in which the limit is passed
    begin = next(m.start() for i, m in enumerate(re.finditer(rb"[^\x20\x09-\x0D]+", text)) if i == k)
    piece = text[begin:].split(None, 1)[0].decode()
    within = limit - (int(sums[k - 1]) if k else 0)
    fits = [i for i, n in enumerate(tables.piece_table(piece)) if n <= within]
    return begin + (len(piece[: fits[-1] + 1].encode()) if fits else 0)


def token_counts(docs: DataFrame, tokenizer_json: str, limit: int = 2048, text_col: str = "text", keep: list[str] | None = None, tables: bool = False) -> DataFrame:
    """docs' columns ``keep`` (all by default) with n_bytes, n_tokens, over_limit and cut_bytes.

    cut_bytes is the length of the longest prefix (of whole code points) that has at most ``limit`` tokens.
    With ``tables``, prefix_tokens holds the whole table: its i-th entry is the count of the first i code
    points. A null or empty text has 0 of everything and an empty table; repeated rows and ties have equal
    results; an empty docs gives no rows; columns of the same names are replaced.
    """
    PrefixTables._check(json.loads(tokenizer_json))
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer_json)  # a vocabulary file: a few MB

    def make():
        made = prefix_tables(shared.value)

        def step(chunk, rows):
            n_tokens, cuts, whole = [], [], []
            data = chunk.data.tobytes()
            known, total = made.pieces, made.total
            for i in range(len(chunk)):
                text = data[chunk.offsets[i] : chunk.offsets[i + 1]]
                pieces = text.split()
                counts = [known[p] if p in known else total(p) for p in pieces]
                n = sum(counts)
                n_tokens.append(n)
                cuts.append(len(text) if n <= limit else _cut(made, text, np.cumsum(counts), limit))
                if tables:
                    whole.append(made.text_table(text.decode()))
            out = {"n_bytes": np.diff(chunk.offsets), "n_tokens": n_tokens, "over_limit": [n > limit for n in n_tokens], "cut_bytes": cuts}
            return out | ({"prefix_tokens": pa.array(whole, pa.list_(pa.int32()))} if tables else {})

        return step

    fields = [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType()), T.StructField("cut_bytes", T.LongType())]
    if tables:
        fields.append(T.StructField("prefix_tokens", T.ArrayType(T.IntegerType())))
    return map_texts(docs, text_col, make, T.StructType(fields), keep)


def prefix_count(code_points: Column | int) -> Column:
    """From a row with tables: tokens of the prefix of so many code points; the whole text's beyond its end."""
    n = F.lit(code_points) if isinstance(code_points, int) else code_points
    return F.when((n <= 0) | (F.size("prefix_tokens") == 0), 0).otherwise(F.element_at("prefix_tokens", F.greatest(F.lit(1), F.least(n, F.size("prefix_tokens")))))


def prefix_within(budget: Column | int) -> Column:
    """From a row with tables: code points of the longest prefix within a token budget."""
    budget = F.lit(budget) if isinstance(budget, int) else budget
    return F.coalesce(F.array_max(F.transform("prefix_tokens", lambda n, i: F.when(n <= budget, i + 1))), F.lit(0))
