"""SentencePiece ids by vectorised merge rounds, and texts back from ids.

The vocabulary's pieces hold white space only in front, so a text falls into words that
never merge with each other.  Each distinct word is cut into symbols once; the symbols of
many words lie in one flat array, in stretches.  A round finds each stretch's smallest pair
rank, merges the leftmost pair of that rank in all stretches at once and closes the gaps,
until no pair is left."""
import codecs
import functools
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from aerofield.llm.common import whole_texts
from aerofield.llm.tokens import Stretches, _spread

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
NONE = np.iinfo(np.int32).max  # rank of what is no pair
BLOCK = 1 << 20  # characters of a text that are looked up at a time
codecs.register_error("aerofield-each", lambda e: ("�", e.start + 1))


class Vocabulary:
    """The model's pieces as symbols, the pairs of symbols that make a piece, and bytes.

    Symbols are the ids of ordinary pieces, then characters that are no piece of their own
    (``size + code point``), which merge with nothing and are spelled in bytes."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = model.get_piece_size()
        ids = range(self.size)
        special = {i for i in ids if model.is_control(i) or model.is_unknown(i) or model.is_byte(i)}
        if any(model.is_unused(i) for i in ids) or not all(model.is_byte(model.piece_to_id(f"<0x{b:02X}>")) for b in range(256)):
            raise ValueError("the vocabulary must spell unknown characters in bytes and have no unused pieces")
        self.names = {i: model.id_to_piece(i) for i in ids if i not in special}
        if any(SPACE in p.lstrip(SPACE) for p in self.names.values()):
            raise ValueError("pieces must hold white space in front only")
        self.byte_ids = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        self.spelled = [b""] * self.size  # what an id stands for
        for i, p in self.names.items():
            self.spelled[i] = p.replace(SPACE, " ").encode()
        for b, i in enumerate(self.byte_ids):
            self.spelled[i] = bytes([b])
        for i in special:
            if model.is_unknown(i):
                self.spelled[i] = " ⁇ ".encode()
        self.leads = np.array([i in self.names and self.names[i].startswith(SPACE) for i in ids])
        self.lengths = np.array([len(s) for s in self.spelled], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.letters = np.frombuffer(b"".join(self.spelled), np.uint8)
        _, rank = np.unique(-np.array([model.get_score(i) for i in self.names]), return_inverse=True)
        self._pairs(dict(zip(self.names, rank.tolist())))
        self._words(dict(zip(self.names, rank.tolist())))

    def _pairs(self, rank: dict[int, int]):
        number = {p: i for i, p in self.names.items()}
        self.char = np.arange(self.size, self.size + 0x110000, dtype=np.int32)
        for p, i in number.items():
            if len(p) == 1:
                self.char[ord(p)] = i
        symbol = number | {c: int(self.char[ord(c)]) for c in set("".join(number))}
        pairs, near = {}, set()
        for p, i in number.items():
            near.update(zip(p, p[1:]))
            for cut in range(1, len(p)):
                a, b = symbol.get(p[:cut]), symbol.get(p[cut:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = (rank[i], i)
        self.keys = np.array(sorted(pairs), np.int64)
        self.rank, self.merged = (np.array([pairs[k][j] for k in self.keys.tolist()], np.int32) for j in (0, 1))
        self.near = np.array(sorted(ord(a) << 32 | ord(b) for a, b in near), np.int64)  # characters that meet in a piece

    def _words(self, rank: dict[int, int]):
        """The pattern of words.  A character that is in no longer piece is a word.  Where
        pieces of white space alone come last, all at one rank, and no other piece begins
        with two, a long run gives longest pieces from its left, one after the other, if
        runs of up to twice that length begin with one: a longest piece merges no more, and
        the leftmost pair comes first."""
        longer = [p for p in self.names.values() if len(p) > 1]
        alone = "".join(re.escape(c) for c in map(chr, range(32)) if not any(c in p for p in longer))
        words = f" +[^ {alone}]*|[^ {alone}]+" + (f"|[{alone}]" if alone else "")
        self.pattern = re.compile(words)
        blank = {i for i, p in self.names.items() if len(p) > 1 and not p.strip(SPACE)}
        last = {rank[i] for i in blank}
        if len(last) != 1 or any(p.startswith(2 * SPACE) and p.strip(SPACE) for p in longer) or any(
                rank[i] >= min(last) for i, p in self.names.items() if p.strip(SPACE)):
            return
        longest = max(blank, key=lambda i: len(self.names[i]))
        m = len(self.names[longest])
        if all(self.encode([" " * n])[0][0] == longest for n in range(m, 2 * m + 1)):
            self.pattern = re.compile(f" {{{m}}}(?= )|{words}")

    def find(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged symbol of pairs (NONE where they are no piece)."""
        if not len(self.keys):
            return np.full(len(a), NONE, np.int32), np.zeros(len(a), np.int32)
        wanted = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.rank[at], NONE), self.merged[at]

    # ---- encoding ----

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words in turn, and how many each has.  White space is a blank."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        code = np.frombuffer("".join(words).replace(" ", SPACE).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        first = np.zeros(len(code) + 1, bool)
        first[np.cumsum(sizes) - sizes] = True
        symbol, at = self._rounds(code, first[:-1])
        word = np.searchsorted(np.cumsum(sizes), at, side="right")
        return self._spelled_out(symbol, word, len(words))

    def _rounds(self, code: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols left when no pair remains, and the places of their first characters.
        ``first`` marks where a word begins; two characters that meet in no piece are cut too."""
        first = first.copy()
        if len(code) > 1:
            meet = code[:-1] << 32 | code[1:]
            spot = np.minimum(np.searchsorted(self.near, meet), max(len(self.near) - 1, 0))
            first[1:] |= (self.near[spot] != meet) if len(self.near) else True
        symbol, at = self.char[code], np.arange(len(code))
        rank, merged = self._ranked(symbol, first)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbol):
            begin = np.flatnonzero(first)
            least = np.minimum.reduceat(rank, begin)
            size = np.diff(np.append(begin, len(symbol)))
            if (least == NONE).any():  # finished stretches leave
                stays = np.repeat(least != NONE, size)
                done.append((symbol[~stays], at[~stays]))
                symbol, at, rank, merged, first = symbol[stays], at[stays], rank[stays], merged[stays], first[stays]
                size, least = size[least != NONE], least[least != NONE]
                if not len(symbol):
                    break
            stretch = np.repeat(np.arange(len(size)), size)
            chosen = self._chosen(np.flatnonzero(rank == least[stretch]), stretch, symbol, merged, first, least)
            symbol[chosen] = merged[chosen]
            stays = np.ones(len(symbol), bool)
            stays[chosen + 1] = False
            place = np.cumsum(stays) - 1
            symbol, at, rank, merged, first = symbol[stays], at[stays], rank[stays], merged[stays], first[stays]
            new = place[chosen]
            new = np.unique(np.concatenate([new, new[new > 0] - 1]))
            rank[new], merged[new] = self._ranked(symbol, first, new)
        if not done:
            return symbol, at
        symbol, at = (np.concatenate([d[k] for d in done]) for k in (0, 1))
        order = np.argsort(at)
        return symbol[order], at[order]

    def _ranked(self, symbol: np.ndarray, first: np.ndarray, at: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged symbol of the pairs that begin at ``at`` (all)."""
        at = np.arange(len(symbol)) if at is None else at
        right = np.minimum(at + 1, len(symbol) - 1)
        rank, merged = self.find(symbol[at], symbol[right])
        rank[(right == at) | first[right]] = NONE
        return rank, merged

    def _chosen(self, hits: np.ndarray, stretch: np.ndarray, symbol: np.ndarray, merged: np.ndarray, first: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The pairs to merge now: of each stretch the leftmost pair of the smallest rank, and
        those after it, up to the first whose result makes a pair that comes before the rest."""
        new_run = np.ones(len(hits), bool)
        new_run[1:] = (np.diff(hits) > 1) | first[hits[1:]]
        begin = np.maximum.accumulate(np.where(new_run, np.arange(len(hits)), 0))
        hits = hits[(np.arange(len(hits)) - begin) % 2 == 0]  # leftmost ones that do not overlap
        own = stretch[hits]
        again = np.flatnonzero(own[1:] == own[:-1])  # followed by another of the same stretch
        if not len(again):
            return hits
        i, made = hits[again], merged[hits[again]]
        before = np.maximum(i - 1, 0)
        left = symbol[before]
        joined = (again > 0) & (hits[again - 1] == i - 2) & (own[again - 1] == own[again])
        left = np.where(joined, merged[hits[again - 1]], left)
        after = np.minimum(i + 2, len(symbol) - 1)
        low = least[own[again]]
        stop = ~first[i] & (self.find(left, made)[0] <= low)
        stop |= (after == i + 2) & ~first[after] & (self.find(made, symbol[after])[0] <= low)
        waits = np.zeros(len(hits), np.int64)
        waits[again + 1] = stop
        count = np.cumsum(waits)
        start = np.concatenate([[0], np.flatnonzero(own[1:] != own[:-1]) + 1])
        base = np.repeat(count[start], np.diff(np.append(start, len(hits))))
        return hits[count == base]

    def _spelled_out(self, symbol: np.ndarray, word: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
        odd = symbol >= self.size
        ids = symbol.astype("<u4")
        if odd.any():
            spelled = [chr(c).encode("utf-8", "surrogatepass") for c in (symbol[odd] - self.size).tolist()]
            times = np.ones(len(symbol), np.int64)
            times[odd] = [len(s) for s in spelled]
            ids, word, odd = np.repeat(ids, times), np.repeat(word, times), np.repeat(odd, times)
            ids[odd] = self.byte_ids[np.frombuffer(b"".join(spelled), np.uint8)]
        return ids, np.bincount(word, minlength=words)

    # ---- decoding ----

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: a blank in front of the first piece is dropped, bytes that are no
        UTF-8 become U+FFFD one by one."""
        ids = np.asarray(ids, np.int64)
        data = self.letters[_spread(self.starts[ids], self.lengths[ids])].tobytes()
        if len(ids):
            some = np.flatnonzero(self.lengths[ids] > 0)  # control ids say nothing
            if len(some) and self.leads[ids[some[0]]]:
                data = data[1:]
        return data.decode("utf-8", "aerofield-each")


class Store:
    """Ids of texts by way of a store of words, which is emptied when full; that changes no
    result."""

    def __init__(self, vocabulary: Vocabulary, most: int = 400_000):
        self.vocabulary, self.most = vocabulary, most
        self._empty()

    def _empty(self):
        self.known: dict[str, int] = {}
        self.words = Stretches()

    def numbers(self, words: list[str]) -> np.ndarray:
        """Places of the words in the store."""
        at = np.fromiter(map(self.known.get, words, itertools.repeat(-1)), np.int64, len(words))
        if (at < 0).any():
            if len(self.known) > self.most:
                self._empty()
                at[:] = -1
            new = list(dict.fromkeys(itertools.compress(words, (at < 0).tolist())))
            ids, sizes = self.vocabulary.encode(new)
            self.known.update(zip(new, self.words.add(ids, sizes, np.zeros(len(new), bool))))
            at = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        return at

    def words_of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words in turn, and how many each has."""
        at = self.numbers(words)  # which may put a new store in place
        return self.words.get(at)

    def split(self, text: str) -> Iterator[list[str]]:
        """Words of a text with its leading blank, a block at a time."""
        if len(text) <= BLOCK:
            yield self.vocabulary.pattern.findall(text)
            return
        found = self.vocabulary.pattern.finditer(text)
        while words := [m.group() for m in itertools.islice(found, BLOCK >> 3)]:
            yield words

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text (with its leading blank); short texts are looked up together."""
        out: list[np.ndarray] = []
        held: list[list[str]] = []
        n = 0

        def told():
            sizes = np.cumsum([0, *map(len, held)])
            ids, each = self.words_of(list(itertools.chain.from_iterable(held)))
            after = np.append(0, np.cumsum(each))[sizes]
            out.extend(ids[a:b] for a, b in zip(after[:-1], after[1:]))
            held.clear()

        for text in texts:
            if len(text) > BLOCK:
                told()
                out.append(np.concatenate([self.words_of(w)[0] for w in self.split(text)]))
                n = 0
                continue
            held.append(next(self.split(text)))
            n += len(held[-1])
            if n > BLOCK >> 3:
                told()
                n = 0
        told()
        return out


def blanked(text: str | None) -> str:
    """A text as the library sees it: a blank in front, blanks for the mark of blanks."""
    return " " + text.replace(SPACE, " ") if text else ""


@functools.cache
def store(path: str) -> Store:
    """One store for each Python worker and vocabulary."""
    return Store(Vocabulary(path))


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(MODEL)


def _mapped(rows: DataFrame, column: str, made: str, kind: T.DataType, run) -> DataFrame:
    """``rows`` with a column ``made`` that ``run`` gives for a batch's ``column``."""
    where = rows.columns.index(column)
    schema = T.StructType(rows.schema.fields + [T.StructField(made, kind)])

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, run(batch.column(where))], names=schema.names)
    return rows.mapInArrow(mapped, schema)


def encoded(docs: DataFrame, text: str = "text", ids: str = "ids", path: str | None = None) -> DataFrame:
    """``docs`` with a column ``ids array<int>``: the vocabulary's ids of each whole text, as
    the SentencePiece library gives them without begin and end ids.

    Null and empty texts have no ids.  Equal rows, and columns of any other name, stay as
    they are; an empty table stays empty.  A long text is looked up a block at a time; the
    ids of a text are one value, and a word's merges take memory in proportion to the word."""
    if ids in docs.columns:
        raise ValueError(f"there is a column {ids} already")
    path = path or model_path()

    def run(column) -> pa.Array:
        found = store(path).encode([blanked(t) for t in column.to_pylist()])
        sizes = np.cumsum([0, *map(len, found)], dtype=np.int64)
        flat = np.concatenate([np.zeros(0, "<u4"), *found]).view("<i4")
        return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(flat, pa.int32()))
    return _mapped(whole_texts(docs), text, ids, T.ArrayType(T.IntegerType()), run)


def decoded(rows: DataFrame, ids: str = "ids", text: str = "decoded", path: str | None = None) -> DataFrame:
    """``rows`` with a column ``text`` that ``ids`` stand for.  Null and empty ids give the
    empty text; equal rows and other columns stay as they are."""
    if text in rows.columns:
        raise ValueError(f"there is a column {text} already")
    path = path or model_path()

    def run(column) -> pa.Array:
        words = store(path).vocabulary
        flat = column.flatten().to_numpy(zero_copy_only=False)
        ends = np.cumsum(np.asarray(column.value_lengths().fill_null(0)), dtype=np.int64)
        return pa.array([words.decode(flat[a:b]) for a, b in zip(np.append(0, ends[:-1]), ends)], pa.string())
    return _mapped(rows, ids, text, T.StringType(), run)


def query(docs: DataFrame) -> DataFrame:
    rows = decoded(encoded(docs.select("doc_id", "text")).drop("text"))
    return rows.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))
