"""Tokeniser fertility as a quality rule: how well a public vocabulary fits a text, with rejection bands per script or language."""

from __future__ import annotations

import base64
import math
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache, reduce
from itertools import count, islice
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scoreloom.llm._common import WORD, slices, written

WORDS = re.compile(WORD)
SYMBOLS = "#*$%&|<>"
WINDOW = 8
CACHED_WORDS = 400_000

#: Where blocks of scripts start, and what letters there belong to.
SCRIPTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0780, "other"), (0x0900, "indic"), (0x0E00, "thai"), (0x0E80, "other"), (0x1100, "hangul"), (0x1200, "other"),
    (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "symbol"), (0x2E80, "han"), (0x3040, "kana"), (0x3100, "han"), (0xAC00, "hangul"),
    (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"), (0x1F000, "symbol"), (0x20000, "han"), (0x30000, "other"),
)
SCRIPT_NAMES = sorted({name for _, name in SCRIPTS})


class Band(NamedTuple):
    """What a text of a script or language must keep to. Below min_tokens tokens min_entropy falls as the logarithm of their number does,
    which is the most that so few tokens can have."""

    min_chars_per_token: float
    max_chars_per_token: float
    max_byte_share: float
    min_entropy: float
    min_tokens: int = 50


#: For texts of languages and scripts with fewer than LEAST sound ones, by vocabularies of pieces. Prose in the vocabulary's own scripts takes
#: 2 to 6 characters a token; in scripts whose letters it has, near one and few bytes; of those under `*` it lacks some wholly: bytes only, 3 a
#: character.
BANDS = {
    "latin": Band(1.0, 12.0, 0.25, 3.0),
    "cyrillic": Band(0.9, 12.0, 0.35, 3.0),
    "greek": Band(0.6, 12.0, 0.4, 3.0),
    **dict.fromkeys(("arabic", "hebrew", "han", "kana", "hangul", "thai"), Band(0.5, 6.0, 0.4, 3.0)),
    "*": Band(0.3, 6.0, 1.0, 2.5),
}

#: The same by byte-level vocabularies made for many languages. A paragraph of prose measured 4.2 characters a token in latin, 2.9 in cyrillic,
#: 1.5 to 1.8 in greek, arabic and hebrew, near one in thai, kana, hangul, han and indic, 0.8 and 0.4 in two scripts that it hardly has; parts of
#: characters were under 0.04 of all tokens in the first four, 0.19 in hebrew, 0.14 to 0.53 in the next five, and up to all in the last.
BYTE_BANDS = {
    "latin": Band(1.0, 12.0, 0.25, 3.0),
    "cyrillic": Band(0.9, 12.0, 0.35, 3.0),
    "greek": Band(0.6, 12.0, 0.4, 3.0),
    **dict.fromkeys(("arabic", "hebrew", "thai", "kana"), Band(0.5, 6.0, 0.5, 3.0)),
    **dict.fromkeys(("han", "indic"), Band(0.4, 6.0, 0.7, 3.0)),
    "hangul": Band(0.4, 6.0, 0.9, 3.0),
    "*": Band(0.3, 6.0, 1.0, 2.5),
}

#: Bands from the documents need so many different ones of a language (or script) and size; where there are fewer, those of sizes so many
#: classes smaller or larger count too, the first of these that has enough, and the last has all.
LEAST = 50
REACH = (0, 1, 2, 4, 8, 64)
#: How many quartile distances from the median a text may be, and (by 1 / sqrt(tokens), times the median) the least such distance.
FAR_CHARS, FAR_ENTROPY, FAR_BYTES, LEAST_SPREAD = 4, 3, 4, 0.3

#: With so many rows at most the bands are sent to all tasks; more of them are joined by their keys.
SENT_BANDS = 100_000

TEXT_MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, script string"
#: Of one vocabulary; those of the second end in _2, and so on.
TOKEN_MEASURES = "n_tokens long, chars_per_token double, tokens_per_word double, byte_share double, token_entropy double"
BANDED = ("chars_per_token", "token_entropy", "byte_share")
BOUNDS = ("low_chars", "high_chars", "low_entropy", "high_bytes")


def suffixes(n_vocabularies: int) -> list[str]:
    return ["", *(f"_{k}" for k in range(2, n_vocabularies + 1))]


def measures(n_vocabularies: int) -> str:
    return ", ".join([TEXT_MEASURES, *(TOKEN_MEASURES.replace(" long", f"{s} long").replace(" double", f"{s} double") for s in suffixes(n_vocabularies))])


def default_vocabularies() -> list[str]:
    """Pieces with single bytes for what they lack, and a byte-level vocabulary made for many languages."""
    import public_tokenizers

    return [public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken")]


def _sentencepiece(path: str):
    """How to cut words by a sentencepiece model, and which of its pieces stand for a single byte."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    return lambda words: model.encode(words, num_threads=1), np.array([model.is_byte(k) for k in range(model.get_piece_size())])


def _ranks(path: str):
    """How to cut words, each after a space, by a byte-level vocabulary, and which of its tokens hold a part of a character."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    model = tiktoken.Encoding("vocabulary", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    part = np.zeros(max(ranks.values()) + 1, bool)
    for token, rank in ranks.items():
        part[rank] = "\ufffd" in token.decode(errors="replace") and token != "\ufffd".encode()
    return lambda words: [model.encode_ordinary(" " + w) for w in words], part


class Pieces:
    """A vocabulary (.model: of sentencepiece, .tiktoken: byte-level ranks), and the pieces of words seen in one flat array."""

    def __init__(self, path: str):
        self.cut, self.is_byte = (_ranks if path.endswith(".tiktoken") else _sentencepiece)(path)
        self._clear()

    def _clear(self) -> None:
        self.words: defaultdict[str, int] = defaultdict(count().__next__)
        self.ids, self.counts, self.places = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def numbers(self, words: list[str]) -> np.ndarray:
        """Each word's number among the words seen; equal numbers mean equal words until the next call."""
        if len(self.words) > CACHED_WORDS:
            self._clear()
        known = len(self.words)
        at = np.fromiter(map(self.words.__getitem__, words), np.int64, len(words))
        if len(self.words) > known:
            found = self.cut(list(islice(self.words, known, None)))
            counts = np.fromiter(map(len, found), np.int64, len(found))
            self.places = np.concatenate([self.places, len(self.ids) + np.cumsum(counts) - counts])
            self.counts = np.concatenate([self.counts, counts])
            self.ids = np.concatenate([self.ids, np.fromiter((k for x in found for k in x), np.int32, int(counts.sum()))])
        return at

    def pieces(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        counts = self.counts[at]
        ends = np.cumsum(counts)
        return self.ids[np.repeat(self.places[at] - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)], np.concatenate([[0], ends])


@lru_cache(maxsize=4)
def _pieces(path: str) -> Pieces:
    return Pieces(path)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def repeat_words(numbers: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Of each text (words numbers[bounds[k]:bounds[k + 1]]): how many words stand in 8-word windows that it has twice or more."""
    total = np.zeros(len(bounds) - 1, np.int64)
    if len(numbers) < WINDOW:
        return total
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    key = _mixed(numbers)
    for step, by in ((1, 0x9DDFEA08EB382D69), (2, 0xC2B2AE3D27D4EB4F), (4, 0x165667B19E3779F9)):
        key = _mixed(key[:-step] * np.uint64(by) + key[step:])
    inside = np.flatnonzero(text[: len(key)] == text[WINDOW - 1 :])
    key = _mixed(key[inside] + text[inside].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    begins = np.concatenate([[True], key[order][1:] != key[order][:-1]]) if len(order) else np.zeros(0, bool)
    first = order[np.flatnonzero(begins)][np.cumsum(begins) - 1] if len(order) else order
    again = np.flatnonzero(order != first)
    a, b = inside[order[again]], inside[first[again]]
    same = text[a] == text[b]
    for k in range(WINDOW):
        same &= numbers[a + k] == numbers[b + k]
    if same.all():
        starts = np.union1d(a, b)
    else:  # two windows share a hash: compare the windows themselves
        windows = np.concatenate([text[inside][:, None], np.lib.stride_tricks.sliding_window_view(numbers, WINDOW)[inside]], axis=1)
        _, of, n = np.unique(windows, axis=0, return_inverse=True, return_counts=True)
        starts = inside[n[of.ravel()] > 1]
    change = np.zeros(len(numbers) + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + WINDOW, -1)
    covered = np.cumsum(change[:-1]) > 0
    return total + np.bincount(text[covered], minlength=len(total))


def _scripts(texts: list[str]) -> list[str]:
    """The script of most of each text's characters outside the symbol blocks; latin where there are none."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    found = ["latin"] * len(texts)
    far = np.flatnonzero(points >= SCRIPTS[1][0])
    if len(far):
        of = np.array([SCRIPT_NAMES.index(name) for _, name in SCRIPTS])[np.searchsorted([at for at, _ in SCRIPTS], points[far], "right") - 1]
        text = np.repeat(np.arange(len(texts)), sizes)
        votes = np.bincount(text[far] * len(SCRIPT_NAMES) + of, minlength=len(texts) * len(SCRIPT_NAMES)).reshape(len(texts), -1)
        votes[:, SCRIPT_NAMES.index("symbol")] = 0
        letters = (points < SCRIPTS[1][0]) & (points > 0x40)
        votes[:, SCRIPT_NAMES.index("latin")] += np.bincount(text[letters], minlength=len(texts))
        for k in np.flatnonzero(votes.sum(axis=1)):
            found[k] = SCRIPT_NAMES[int(votes[k].argmax())]
    return found


def _token_measures(pieces: Pieces, at: np.ndarray, bounds: np.ndarray, word_chars: np.ndarray) -> list[pa.Array]:
    """TOKEN_MEASURES of each text (words at[bounds[k]:bounds[k + 1]], as numbered by pieces)."""
    n_texts, n_words = len(bounds) - 1, np.diff(bounds)
    ids, ends = pieces.pieces(at)
    n_tokens = np.diff(ends[bounds])
    text = np.repeat(np.arange(n_texts), n_tokens)
    n_bytes = np.bincount(text[pieces.is_byte[ids]], minlength=n_texts)
    key = np.sort((text << 20) | ids)
    begins = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    shares = np.diff(np.append(begins, len(key))) / n_tokens[key[begins] >> 20]
    entropy = np.bincount(key[begins] >> 20, weights=-shares * np.log2(shares), minlength=n_texts) if len(key) else np.zeros(n_texts)
    n = np.maximum(n_tokens, 1)
    return [pa.array(n_tokens.astype(np.int64)), *map(pa.array, (word_chars / n, n_tokens / np.maximum(n_words, 1), n_bytes / n, entropy + 0.0))]


def _measured(texts: list[str], *vocabularies: Pieces) -> list[pa.Array]:
    words = [WORDS.findall(t) for t in texts]
    bounds = np.cumsum([0, *map(len, words)])
    flat = [w for x in words for w in x]
    numbers = [v.numbers(flat) for v in vocabularies]
    lengths = np.fromiter(map(len, flat), np.int64, len(flat))
    chars = np.concatenate([[0], np.cumsum(lengths)])
    word_chars = np.diff(chars[bounds])
    dup_lines = []
    for t in texts:
        lines = [x for x in t.split("\n") if x.strip(" \t\x0b\x0c\r")] if "\n" in t else ()
        dup_lines.append(len(lines) - len(set(lines)))
    return [
        *map(pa.array, (np.diff(bounds), word_chars)),
        pa.array([sum(map(t.count, SYMBOLS)) for t in texts], pa.int64()),
        pa.array(dup_lines, pa.int64()),
        pa.array(repeat_words(numbers[0], bounds)),
        pa.array(_scripts(texts), pa.string()),
        *(column for v, at in zip(vocabularies, numbers) for column in _token_measures(v, at, bounds, word_chars)),
    ]


def verdict(script: str, lang: str | None, n_tokens: int, chars_per_token: float, byte_share: float, entropy: float, bands: dict[str, Band]) -> bool:
    """Whether a text keeps to its band: that of its language if there is one, else of its script, else of `*`."""
    band = bands.get(f"lang:{lang}") or bands.get(script) or bands["*"]
    return bool(
        n_tokens > 0
        and band.min_chars_per_token <= chars_per_token <= band.max_chars_per_token
        and byte_share <= band.max_byte_share
        and entropy >= band.min_entropy * min(1.0, math.log2(n_tokens) / math.log2(band.min_tokens))
    )


def fixed_bands(path: str) -> dict[str, Band]:
    """BANDS or BYTE_BANDS, by what kind of vocabulary is at path."""
    return BYTE_BANDS if path.endswith(".tiktoken") else BANDS


def _sent(table: DataFrame) -> DataFrame:
    """A written table, to be sent to all tasks if it is small."""
    return F.broadcast(table) if table.count() <= SENT_BANDS else table


def derived_bands(found: DataFrame, ends: list[str], *names: str) -> DataFrame:
    """(names, size, and BOUNDS of each vocabulary): bands from the quartiles of measured rows, by names and size.

    size: the power of two under a text's tokens, as measures of short texts differ more. A size with fewer than LEAST different rows takes its
    neighbours in, as REACH says; as a text cut in half has at most about one bit of entropy less, a larger row counts there with a bit less for
    each class between. Only names with fewer than LEAST rows in all have no band. Rows that agree in their measures count once, so copies of a
    text have no weight. Rows that failed don't count. ends: what the measures' names end in, by vocabulary.
    """
    columns = [c + end for end in ends for c in BANDED]
    sound = found.where(~F.col("base_failed") & (F.col("n_tokens") > 0)).where(" and ".join(f"{n} is not null" for n in names))
    each = written(sound.select(*names, "size", "n_tokens", "word_chars", *(F.round(c, 3).alias(c) for c in columns)).distinct(), "measures")
    order = Window.partitionBy(*names).orderBy("size")
    reach = F.coalesce(*(F.when(F.sum("n").over(order.rangeBetween(-r, r)) >= LEAST, r) for r in REACH))
    sizes = each.groupBy(*names, "size").agg(F.count("*").alias("n")).withColumn("reach", reach).where("reach is not null")
    taken = sizes.select(*names, F.col("size").alias("of"), F.explode(F.sequence(F.col("size") - F.col("reach"), F.col("size") + F.col("reach"))).alias("size"))
    rows = each.join(_sent(written(taken, "sizes")), [*names, "size"])
    less = F.greatest(F.col("size") - F.col("of"), F.lit(0))
    rows = rows.select(*names, F.col("of").alias("size"), *((F.col(c) - less if c.startswith("token_entropy") else F.col(c)).alias(c) for c in columns))
    by = rows.groupBy(*names, "size").agg(*(F.percentile(c, [0.25, 0.5, 0.75]).alias(c) for c in columns))
    bounds = []
    for end in ends:
        c, e, b = (F.col(x + end) for x in BANDED)
        spread = F.greatest(c[2] - c[0], LEAST_SPREAD * c[1] / F.sqrt(F.pow(F.lit(2.0), "size")))
        low_entropy, high_bytes = e[1] - FAR_ENTROPY * F.greatest(e[2] - e[0], F.lit(0.1)), b[2] + FAR_BYTES * F.greatest(b[2] - b[0], F.lit(0.02))
        bounds += [x.alias(name + end) for x, name in zip((c[1] - FAR_CHARS * spread, c[1] + FAR_CHARS * spread, low_entropy, high_bytes), BOUNDS)]
    return by.select(*names, "size", *bounds)


def _with_bands(rows: DataFrame, ends: list[str], names: list[str], column: str) -> DataFrame:
    bounds = F.struct(*(b + end for end in ends for b in BOUNDS)).alias(column)
    bands = written(derived_bands(rows, ends, *names).select(*names, "size", bounds), "bands")
    return rows.join(_sent(bands), [*names, "size"], "left")


def judged(found: DataFrame, n_vocabularies: int) -> DataFrame:
    """Measured rows with kept by the bands of their language and script, else of their script; where neither has one, as it was.

    A text must keep to the bands of every vocabulary."""
    ends = suffixes(n_vocabularies)
    sized = found.withColumn("size", F.floor(F.log2(F.greatest("n_tokens", F.lit(1)))))
    rows = _with_bands(_with_bands(sized, ends, ["lang", "script"], "of_lang"), ends, ["script"], "of_script")
    band = F.coalesce("of_lang", "of_script")
    fits = reduce(lambda x, y: x & y, [
        F.col(f"chars_per_token{end}").between(band[f"low_chars{end}"], band[f"high_chars{end}"])
        & (F.col(f"token_entropy{end}") >= band[f"low_entropy{end}"]) & (F.col(f"byte_share{end}") <= band[f"high_bytes{end}"])
        for end in ends
    ])
    return rows.withColumn("kept", F.when(band.isNull() | F.col("base_failed"), F.col("kept")).otherwise(fits)).select(*(c for c in found.columns if c != "lang"))


def measure(
    docs: DataFrame,
    vocabularies: list[str] | None = None,
    bands: dict[str, Band] | list[dict[str, Band]] | None = None,
    min_words: int = 20,
    max_repeat_percent: int = 30,
) -> DataFrame:
    """The measures of each row of docs (doc_id, text, lang): doc_id, base_failed, kept, then TEXT_MEASURES and each vocabulary's TOKEN_MEASURES.

    Each word (between white space of ASCII) is cut into pieces of each of the vocabularies (paths) on its own, so equal words are cut
    once. chars_per_token: characters of words per piece; byte_share: pieces that stand for a single byte or part of a character, as the
    vocabulary lacks the character; token_entropy: bits of the text's own distribution of pieces.

    Bands that are given go by script ("latin") or language ("lang:de"); a list has those of each vocabulary, others are for the first.
    Without them they come, for every vocabulary, from the documents themselves: see derived_bands; fixed_bands are for languages and scripts
    with too few. The measures are written to the shared folder for that.

    base_failed: fewer than min_words words, or over max_repeat_percent percent of them in 8-word windows that occur again. kept:
    not base_failed, and within the bands. Null and empty texts have no words and fail. Every row is measured alone, whatever its length, and
    repeated rows alike. An empty table gives no row.
    """
    paths, derive = vocabularies or default_vocabularies(), bands is None
    given = [fixed_bands(path) for path in paths] if bands is None else [bands] if isinstance(bands, dict) else bands
    names = [x.split()[0] for x in measures(len(paths)).split(", ")]
    of_verdict = [[names.index(x + end) for x in ("n_tokens", "chars_per_token", "byte_share", "token_entropy")] for end in suffixes(len(paths))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [_pieces(path) for path in paths]
        for batch in slices(batches):
            columns = _measured([t or "" for t in batch.column("text").to_pylist()], *known)
            n_words, repeats = np.asarray(columns[0]), np.asarray(columns[names.index("n_repeat_words")])
            failed = (n_words < min_words) | (100 * repeats > max_repeat_percent * n_words)
            of_text, fits = (columns[names.index("script")].to_pylist(), batch.column("lang").to_pylist()), np.ones(batch.num_rows, bool)
            for own, at in zip(given, of_verdict):
                fits &= np.array([verdict(*x, own) for x in zip(*of_text, *(columns[k].to_pylist() for k in at))], bool)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(failed), pa.array(~failed & fits), *columns, batch.column("lang")], names=["doc_id", "base_failed", "kept", *names, "lang"])

    found = docs.select("doc_id", "text", "lang").mapInArrow(run, f"doc_id long, base_failed boolean, kept boolean, {measures(len(paths))}, lang string")
    return judged(written(found, "fertility"), len(paths)) if derive else found.drop("lang")
