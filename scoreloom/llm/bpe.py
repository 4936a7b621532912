"""BPE encoding and decoding with a public byte-level vocabulary, in batched numpy merge rounds."""

from __future__ import annotations

import hashlib
import json
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import count, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from scoreloom.llm._common import map_arrow, slices, with_fields

#: The pattern that cuts text into words before merging, and Unicode's white space spelled out.
SPACES = r"\t-\r \x85\xa0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
PATTERN = regex.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACES}\p{{L}}\p{{N}}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+"
)
NONE = np.int32(np.iinfo(np.int32).max)
#: A worker that has met more words than this starts anew with the next slice of texts.
CACHED_WORDS = 500_000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in such vocabularies: printable ones for themselves, others from U+0100 on in turn."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b if b in printable else next(others)) for b in range(256)]


class Vocabulary:
    """Merges as sorted pair keys with ranks, and the bytes of each id. words: ids of words seen, in one flat array."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        letters = byte_letters()
        self.byte_ids = np.array([vocab[x] for x in letters], np.int32)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        keys = np.array([(vocab[a] << 20) | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        of_letter = {x: b for b, x in enumerate(letters)}
        spelled = {i: bytes(of_letter[c] for c in token) for token, i in vocab.items()}
        spelled |= {i: token.encode() for token, i in self.special.items()}
        table = [spelled.get(i, b"") for i in range(max(spelled) + 1)]
        self.flat = np.frombuffer(b"".join(table), np.uint8)
        self.lengths = np.array([len(x) for x in table], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self._clear()

    def _clear(self) -> None:
        self.words: defaultdict[str, int] = defaultdict(count(len(self.special)).__next__, {x: k for k, x in enumerate(self.special)})
        self.ids = np.array(list(self.special.values()), np.int32)
        self.counts = np.ones(len(self.special), np.int64)
        self.places = np.arange(len(self.special), dtype=np.int64)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left.astype(np.int64) << 20) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words one after another, and how many each has.

        All words' symbols stand in one array. A round merges, in every word, the pair of lowest rank wherever it stands (from the
        left where it overlaps itself); a later merge never makes a pair of lower rank than that which made it, so this is the
        order of one merge at a time. Ranks are searched anew only beside merges; finished words leave.
        """
        lengths = np.array([len(w) for w in words], np.int64)
        symbols = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), lengths)
        done_ids, done_words = [], []
        rank = np.full(len(symbols), NONE, np.int32)
        inner = np.flatnonzero(word[:-1] == word[1:])
        rank[inner] = self._rank(symbols[inner], symbols[inner + 1])
        while len(symbols):
            starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            least = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.append(starts, len(symbols)))
            over = least == NONE
            if over.any():
                gone = np.repeat(over, sizes)
                done_ids.append(symbols[gone])
                done_words.append(word[gone])
                stay = ~gone
                symbols, word, rank = symbols[stay], word[stay], rank[stay]
                least, sizes = least[~over], sizes[~over]
                if not len(symbols):
                    break
            hit = rank == np.repeat(least, sizes)
            places = np.flatnonzero(hit)
            begins = np.concatenate([[True], np.diff(places) != 1])
            run = np.flatnonzero(begins)
            nth = np.arange(len(places)) - np.repeat(run, np.diff(np.append(run, len(places))))
            places = places[nth % 2 == 0]
            symbols[places] = self.merged[rank[places]]
            stay = np.ones(len(symbols), bool)
            stay[places + 1] = False
            moved = places - np.arange(len(places))
            symbols, word, rank = symbols[stay], word[stay], rank[stay]
            again = np.union1d(moved, moved[moved > 0] - 1)
            rank[again] = NONE
            again = again[again < len(symbols) - 1]
            again = again[word[again] == word[again + 1]]
            rank[again] = self._rank(symbols[again], symbols[again + 1])
        word, ids = np.concatenate([np.zeros(0, np.int64), *done_words]), np.concatenate([np.zeros(0, np.int32), *done_ids])
        return ids[np.argsort(word, kind="stable")], np.bincount(word, minlength=len(words))

    def _places(self, tokens: list[str]) -> np.ndarray:
        """The number of each token among the words seen; new words are merged first, all at once."""
        if len(self.words) > CACHED_WORDS:
            self._clear()
        known = len(self.words)
        at = np.fromiter(map(self.words.__getitem__, tokens), np.int64, len(tokens))
        if len(self.words) > known:
            ids, counts = self.merge([w.encode() for w in islice(self.words, known, None)])
            self.places = np.concatenate([self.places, len(self.ids) + np.cumsum(counts) - counts])
            self.counts = np.concatenate([self.counts, counts])
            self.ids = np.concatenate([self.ids, ids])
        return at

    def cut(self, text: str) -> list[str]:
        """text as words, joined again the same text; strings of special tokens stand alone."""
        if self.split and any(x in text for x in self.special):
            return [w for part in self.split.split(text) for w in ([part] if part in self.special else PATTERN.findall(part))]
        return PATTERN.findall(text)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and where each text's start (with the end as the last)."""
        cut = [self.cut(t) if t else [] for t in texts]
        tokens = [w for words in cut for w in words]
        at = self._places(tokens)
        counts = self.counts[at]
        ends = np.cumsum(counts)
        ids = self.ids[np.repeat(self.places[at] - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)]
        bounds = np.concatenate([[0], ends])[np.cumsum([0, *map(len, cut)])]
        return ids, bounds

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
        """The texts of ids, cut at bounds; bytes that are no UTF-8 become U+FFFD."""
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        flat = self.flat[np.repeat(self.starts[ids] - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)].tobytes()
        cuts = np.concatenate([[0], ends])[bounds]
        return [flat[a:b].decode("utf-8", "replace") for a, b in zip(cuts[:-1], cuts[1:])]


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """docs with the column ids (array of int): the whole text's token ids. Null and empty texts have none.

    path: of the vocabulary, a file that each executor has; the default is the installed public one. Strings of special tokens in
    a text become those tokens. A column of docs that is named ids is replaced.
    """
    path = path or default_vocabulary()
    docs = docs.drop("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path)
        for batch in slices(batches):
            ids, bounds = words.encode(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))], names=[*batch.schema.names, "ids"])

    return map_arrow(docs, run, with_fields(docs.schema, "ids array<int>"))


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """encoded with the column decoded: the text of its ids. Null ids: an empty text. A column that is named decoded is replaced."""
    path = path or default_vocabulary()
    encoded = encoded.drop("decoded")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path)
        for batch in batches:
            lists = batch.column("ids")
            bounds = np.concatenate([[0], np.cumsum(pa.compute.fill_null(pa.compute.list_value_length(lists), 0))]).astype(np.int64)
            texts = words.decode(np.asarray(lists.flatten(), dtype=np.int64), bounds)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "decoded"])

    return map_arrow(encoded, run, with_fields(encoded.schema, "decoded string"))


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): `encode`, then `decode` of its ids, in one pass, so that ids stay in the task.

    ids_sha256 is of the ids as little-endian unsigned 32-bit integers, decoded_sha256 of the decoded text in UTF-8.
    """
    path = path or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path)
        for batch in slices(batches):
            ids, bounds = words.encode(batch.column("text").to_pylist())
            texts = words.decode(ids, bounds)
            raw = ids.astype("<u4")
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(np.diff(bounds), pa.int64()),
                    pa.array([hashlib.sha256(raw[a:b].tobytes()).hexdigest() for a, b in zip(bounds[:-1], bounds[1:])], pa.string()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts], pa.string()),
                ],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
