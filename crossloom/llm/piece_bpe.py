"""SentencePiece BPE encoding and decoding: exact results without a merge queue.

Encoding walks a text with the longest matches of an Aho-Corasick automaton and backtracks. Two adjacent tokens are
compatible if re-merging their parts would not have merged across their border earlier; a bitfield remembers positions
from which no compatible tokenisation exists. So every position fails at most once.

No piece joins a letter to a following space mark, so merges never cross a word's start: each text is cut before every
run of spaces (and after letters, where the pieces allow it), and each distinct word is encoded once in a worker (a bounded memo; a miss is only slower). Space runs are
the one place where pieces tie in score; they are merged left to right. Both properties are checked when a model is
loaded; a model without them is refused.

Cases: a null text is an empty one, and an empty text has no ids. Characters without a piece become byte pieces. Texts may
be of any length: work and memory grow in proportion. Other columns of the input are carried along, but for those named like what is
added: these are replaced. Ties, repeated rows and null ids need no care: each row is encoded on its own. An empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import heapq
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from crossloom.llm._columns import kept
from crossloom.runtime import prepare

MEMO_WORDS = 250_000
MEMO_PAIRS = 500_000
SPACE = "▁"
LATIN = "A-Za-zÀ-ÖØ-öø-ɏ"


class PieceModel:
    """A BPE model with byte fallback, read from a SentencePiece file."""

    def __init__(self, model_file: str):
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        self.byte_id: dict[int, int] = {}
        self.byte_of: dict[int, int] = {}
        self.control = {i for i in range(n) if sp.is_control(i)}
        self.unknown = sp.unk_id()
        plain = []
        for i, p in enumerate(self.pieces):
            if sp.is_byte(i):
                self.byte_id[int(p[3:5], 16)], self.byte_of[i] = i, int(p[3:5], 16)
            elif i not in self.control and i != self.unknown:
                plain.append(i)
        if len(self.byte_id) != 256:
            raise ValueError("the model has no byte fallback")
        if any(SPACE in self.pieces[i].lstrip(SPACE) or SPACE * 2 == self.pieces[i][:2] and self.pieces[i].strip(SPACE) for i in plain):
            raise ValueError("a piece goes across a word's start")
        self.id_of = {self.pieces[i]: i for i in plain}
        score = {i: sp.get_score(i) for i in plain}
        self.score = score
        words = sorted((i for i in plain if not (len(self.pieces[i]) > 1 and not self.pieces[i].strip(SPACE))), key=lambda i: (len(self.pieces[i]) > 1, -score[i]))
        multi = [i for i in words if len(self.pieces[i]) > 1]
        if any(score[a] == score[b] for a, b in zip(multi, multi[1:], strict=False)) or any(score[self.id_of[SPACE * k]] > min(map(score.get, multi)) for k in range(2, 99) if SPACE * k in self.id_of):
            raise ValueError("pieces tie in score")
        self._build(words, ahocorasick)
        self.memo: dict[str, tuple[int, ...]] = {}
        self.memo_text: dict[str, tuple[int, str, str]] = {}
        self.older: dict[str, tuple[int, str, str]] = {}
        self.shown = [None if i in self.byte_of else "" if i in self.control else " ⁇ " if i == self.unknown else p.replace(SPACE, " ") for i, p in enumerate(self.pieces)]
        self.decimal = [str(i) for i in range(n)]
        self._cut = self._cutter()

    def _build(self, words: list[int], ahocorasick) -> None:
        """Ranks, splits and prefixes of the pieces that merging can make, in the order of merging."""
        self.rank: dict[str, int] = {}
        self.halves: list[tuple[int, int]] = []
        self.text: list[str] = []
        for i in words:
            p = self.pieces[i]
            half = None
            if len(p) > 1:
                for k in range(1, len(p)):
                    a, b = self.rank.get(p[:k]), self.rank.get(p[k:])
                    if a is not None and b is not None and self._compatible(a, b):
                        half = (a, b)
                        break
                if half is None:
                    continue  # no series of merges makes it
            r = len(self.text)
            self.rank[p] = r
            self.text.append(p)
            self.halves.append(half or (r, r))
        self.piece_id = [self.id_of[p] for p in self.text]
        self.longest_prefix = [next((self.rank[p[:k]] for k in range(len(p) - 1, 0, -1) if p[:k] in self.rank), -1) for p in self.text]
        self.size = [len(p) for p in self.text]
        self.alphabet = frozenset(p for p in self.text if len(p) == 1)
        self.pairs: dict[int, bool] = {}
        self.automaton = ahocorasick.Automaton()
        for p, r in self.rank.items():
            self.automaton.add_word(p, r)
        self.automaton.make_automaton()

    def _compatible(self, left: int, right: int) -> bool:
        """Do two adjacent tokens stay apart? Undo their merges from the latest on; a merge across the border that comes
        before one of those undone would have been done first."""
        text, halves, rank = self.text, self.halves, self.rank
        limit = 1 << 60
        while True:
            joined = rank.get(text[left] + text[right])
            if joined is not None and joined < limit:
                return False
            if left > right:
                limit, left = left, halves[left][1]
                if left == limit:
                    limit, right = right + 1, halves[right][0]
                    if right + 1 == limit:
                        return True
            else:
                limit, right = right + 1, halves[right][0]
                if right + 1 == limit:
                    limit, left = left, halves[left][1]
                    if left == limit:
                        return True

    def _fits(self, left: int, right: int) -> bool:
        """``_compatible`` with a bounded memo: few pairs make up most of all text."""
        key = left << 20 | right
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= MEMO_PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self._compatible(left, right)
        return known

    def _backtrack(self, word: str) -> list[int]:
        """Ranks of a word whose characters all have pieces."""
        n = len(word)
        size, shorter, fits = self.size, self.longest_prefix, self._fits
        longest = [0] * n
        for end, r in self.automaton.iter(word):  # in the order of ends, so a start's last match is its longest
            longest[end - size[r] + 1] = r
        token = longest[0]
        if size[token] == n:
            return [token]
        open_ = bytearray(b"\x01") * (n + 1)
        out: list[int] = []
        at, last = 0, -1
        while True:
            while token >= 0 and not (open_[at + size[token]] and (last < 0 or fits(last, token))):
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at += size[token]
                if at == n:
                    return out
                last, token = token, longest[at]
            else:
                open_[at] = 0
                token = out.pop()
                at -= size[token]
                last = out[-1] if out else -1

    def _space_run(self, n: int) -> list[int]:
        """Ids of n space marks: equal scores merge from the left."""
        parts: list[str | None] = [SPACE] * n
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        score = lambda s: self.score[self.id_of[s]] if s in self.id_of else None
        heap: list = []

        def offer(i: int) -> None:
            j = after[i] if i >= 0 else n
            if i >= 0 and j < n and (s := score(parts[i] + parts[j])) is not None:
                heapq.heappush(heap, (-s, i, len(parts[i]), len(parts[j])))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i] if parts[i] is not None else n
            if j >= n or len(parts[i]) != a or len(parts[j]) != b:
                continue
            parts[i], parts[j], after[i] = parts[i] + parts[j], None, after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(before[i])
            offer(i)
        return [self.id_of[p] for p in parts if p is not None]

    def _word(self, word: str) -> list[int]:
        """Ids of a run of space marks and the characters up to the next one."""
        bare = word.lstrip(SPACE)
        spaces = len(word) - len(bare)
        if spaces <= 1:
            return self._known(word)
        ids = self._known(SPACE + bare) if bare else []
        if bare and ids[0] != self.id_of[SPACE]:
            return self._space_run(spaces - 1) + ids
        return self._space_run(spaces) + ids[1:]

    def _known(self, word: str) -> list[int]:
        piece = self.piece_id
        if self.alphabet.issuperset(word):
            return [piece[r] for r in self._backtrack(word)]
        ids: list[int] = []
        start = 0
        for k, c in enumerate(word):
            if c not in self.alphabet:
                if k > start:
                    ids += [piece[r] for r in self._backtrack(word[start:k])]
                ids += [self.byte_id[b] for b in c.encode()]
                start = k + 1
        if start < len(word):
            ids += [piece[r] for r in self._backtrack(word[start:])]
        return ids

    def _cutter(self) -> re.Pattern:
        """Texts are cut before each run of space marks and, if no piece has a Latin letter before another character, after
        each run of Latin letters."""
        latin = re.compile(f"[{LATIN}][^{LATIN}]")
        if any(latin.search(p) for p in self.rank):
            return re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
        return re.compile(f"{SPACE}*[^{SPACE}{LATIN}]*[{LATIN}]+|{SPACE}+[^{SPACE}{LATIN}]*|[^{SPACE}{LATIN}]+")

    def words(self, text: str) -> list[str]:
        """The pieces of a text between which nothing merges, with the mark that stands before the first word."""
        return self._cut.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        memo = self.memo
        for w in self.words(text):
            ids = memo.get(w)
            if ids is None:
                ids = tuple(self._word(w))
                if len(memo) >= MEMO_WORDS:
                    memo.clear()
                if len(w) <= 64:
                    memo[w] = ids
            out += ids
        return out

    def _strings(self, ids) -> str:
        """Text of ids, space marks as spaces: runs of byte pieces are read as UTF-8, each byte that isn't part of a
        character as U+FFFD."""
        shown = self.shown
        try:
            return "".join([shown[i] for i in ids])
        except TypeError:  # there are byte pieces
            pass
        out, run = [], bytearray()
        for i in ids:
            if shown[i] is None:
                run.append(self.byte_of[i])
                continue
            if run:
                out.append(_utf8(run))
                run = bytearray()
            out.append(shown[i])
        if run:
            out.append(_utf8(run))
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        text = self._strings(ids)
        first = next((i for i in ids if i not in self.control), None)
        return text[1:] if first is not None and first not in self.byte_of and first != self.unknown and text.startswith(" ") else text

    def _entry(self, w: str) -> tuple[int, str, str]:
        """A word's part of a digest. The memo has two generations: words in use stay, memory is bounded."""
        known = self.older.get(w)
        if known is None:
            x = self._word(w)
            decimal = self.decimal
            known = len(x), ",".join([decimal[i] for i in x]), self._strings(x)
        if len(self.memo_text) >= MEMO_WORDS:
            self.older, self.memo_text = self.memo_text, {}
        if len(w) <= 64:
            self.memo_text[w] = known
        return known

    def digest(self, text: str) -> tuple[int, str, str]:
        """(count of ids, sha256 of the decimal ids with commas, sha256 of the decoded text)."""
        n, ids, shown = 0, [], []
        for w in self.words(text):
            known = self.memo_text.get(w) or self._entry(w)
            n += known[0]
            ids.append(known[1])
            shown.append(known[2])
        decoded = "".join(shown)
        decoded = decoded[1:] if decoded.startswith(" ") else decoded
        return n, hashlib.sha256(",".join(ids).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


def _utf8(run: bytes) -> str:
    """As ``bytes.decode`` does it, but each wrong byte becomes a U+FFFD of its own."""
    out, at = [], 0
    run = bytes(run)
    while at < len(run):
        for k in (1, 2, 3, 4):
            try:
                out.append(run[at : at + k].decode())
                at += k
                break
            except UnicodeDecodeError:
                if k == 4 or at + k >= len(run):
                    out.append("�")
                    at += 1
                    break
    return "".join(out)


_MODELS: dict[str, PieceModel] = {}


def model(model_file: str) -> PieceModel:
    """One model a worker and file."""
    if model_file not in _MODELS:
        _MODELS[model_file] = PieceModel(model_file)
    return _MODELS[model_file]


def _added(df: DataFrame, fields: list[tuple[str, T.DataType]], row, text_col: str) -> DataFrame:
    prepare(df.sparkSession)
    keep = kept(df, [n for n, _ in fields])
    schema = T.StructType([*(df.schema.fields[k] for k in keep), *(T.StructField(n, t) for n, t in fields)])
    at = df.columns.index(text_col)

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        kinds = [to_arrow_type(t) for _, t in fields]
        for b in batches:
            rows = [row(x or "") for x in b.column(at).to_pylist()]
            cols = [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), *cols], names=schema.names)

    return df.mapInArrow(run, schema)


def encode(df: DataFrame, model_file: str, text_col: str = "text", out: str = "ids") -> DataFrame:
    """All columns and ``out``: the ids of each whole text."""
    return _added(df, [(out, T.ArrayType(T.IntegerType()))], lambda x: (model(model_file).encode(x),), text_col)


def decode(df: DataFrame, model_file: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """All columns and ``out``: the text of each list of ids (null: empty)."""
    return _added(df, [(out, T.StringType())], lambda x: (model(model_file).decode(list(x)),), ids_col)


def digests(df: DataFrame, model_file: str, text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encodes and decodes without sending the ids anywhere."""
    kinds = [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())]
    return _added(df.select("doc_id", text_col), kinds, lambda x: model(model_file).digest(x), text_col).drop(text_col)
