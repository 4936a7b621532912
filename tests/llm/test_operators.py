"""Each operator against brute force on small fixtures with nulls, empty and long texts, ties, repeats and odd columns."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash

pytest.importorskip("scoreloom.llm")

from pyspark.sql import functions as F  # noqa: E402

from scoreloom.llm import bpe, compaction, fertility, language_id, line_dedup, minhash, mixing, queries, simhash, suffix_dedup, warc  # noqa: E402
from scoreloom.llm._common import numbered, shared_dir  # noqa: E402

SF = "/root/testdata/sf0.001"
#: Columns of documents, and others that are named as helpers are.
ODD = ["version", "key", "row", "part", "nth", "copies", "bitmap", "n_dropped", "_n", "_id", "_salt", "score", "cid", "component_id"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in ODD)


def words(n, seed):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("abcdefgéß", k=rng.randint(1, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    base = words(120, 1)
    texts = [base, base, base.replace(" a", " b", 1), "x " + base, None, "", "   \n ", "é" * 5000, words(300, 2) + "\n" + base, "same line here\nsame line here\nother",
             "Same Line Here \nq", words(40, 3) + " <|endoftext|> 😀", "1 2 3", words(2000, 4), base.upper()]
    texts.append(words(150_000, 6) + "\n" + words(30, 7))
    rows = [(k * 3, t, "en" if k % 2 else None, ("s" + str(k % 3)) if k % 5 else None, 0, *ODD) for k, t in enumerate(texts)]
    rows += [rows[3], rows[3], rows[10], *[(None, t, "en", "s0", 0, *ODD) for t in (base, base, "of no one", None)], (9, "another text of nine", None, None, 0, *ODD)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def pairs_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def texts_of(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(name, same_as_sql):
    same_as_sql(queries.QUERIES[name], queries.SQL[name])


OPERATORS = {
    "fertility": fertility.measure, "simhash": simhash.edit_test, "suffix": suffix_dedup.span_digests, "suffix_texts": suffix_dedup.remove_repeats, "minhash": minhash.near_duplicates, "keep_first": minhash.keep_first,
    "bpe": bpe.encode, "round_trip": bpe.round_trip, "lines": line_dedup.line_digests, "drop_lines": line_dedup.drop_lines, "mixing": mixing.mix, "taken": mixing.taken_rows,
    "language": lambda d: language_id.predict(d, language_id.fit(d, per_lang=5)),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_tables_and_one_row_for_each(name, docs):
    assert name in ("keep_first", "taken") or len(OPERATORS[name](docs).collect()) == docs.count()
    assert OPERATORS[name](docs.limit(0)).collect() == []


def lines_left(rows, min_chars=10):
    """The lines of each row that stay, by brute force."""
    key = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    first = {}
    for d, t in rows:
        for x in (t or "").split("\n") if d is not None else ():
            first[key(x)] = min(d, first.get(key(x), d))
    return [[x for x in (t or "").split("\n") if d is None or len(key(x)) < min_chars or first[key(x)] == d] for d, t in rows]


def test_lines_of_odd_rows(docs):
    rows = pairs_of(docs)
    left = lines_left(rows)
    wanted = Counter((d, len((t or "").split("\n")), len((t or "").split("\n")) - len(x), hashlib.sha256("\n".join(x).encode()).hexdigest()) for (d, t), x in zip(rows, left))
    assert Counter(map(tuple, line_dedup.line_digests(docs).collect())) == wanted
    got = line_dedup.drop_lines(docs)
    assert got.columns == docs.columns
    assert Counter((r.doc_id, r.text, r.bitmap) for r in got.collect()) == Counter((d, None if t is None else "\n".join(x), "bitmap") for (d, t), x in zip(rows, left))


def test_repeats_in_odd_rows(spark, docs):
    rows = pairs_of(docs)
    assert Counter(map(tuple, suffix_dedup.span_digests(docs).collect())) == repeats(rows)
    passage = words(60, 70)
    many = [(5, f"{words(3, k)} {passage} {words(2, k + 1)}") for k in range(200)] + [(5, passage)] * 50 + [(None, passage)] * 50 + [(k, f"{passage} {k}") for k in range(10)]
    df = spark.createDataFrame(many, "doc_id long, text string").repartition(4)
    assert Counter(map(tuple, suffix_dedup.span_digests(df).collect())) == repeats(many)


def test_anchors_in_pieces():
    text = (words(300, 1) + words(40, 2) * 6).encode()
    flat, offsets = np.frombuffer(text, np.uint8), np.array([0, 0, 700, 750, len(text)])
    for piece in (1, 7, 100, 333):
        for x, y in zip(suffix_dedup.anchors(flat, offsets, 100, piece), suffix_dedup.anchors(flat, offsets, 100)):
            assert x.tolist() == y.tolist()


def test_minhash_of_odd_rows(spark, docs):
    rows = [(d, t) for d, t in pairs_of(docs)]
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs).collect()) == Counter(components_of(rows, 5, 80))
    first = {c for _, _, c in components_of(rows, 5, 80)}
    assert Counter((r.doc_id, r.text) for r in minhash.keep_first(docs).collect()) == Counter((d, t) for d, t in rows if d is None or d in first)


def test_mixing_of_odd_rows(spark, docs):
    rows = [(None, words(50, k % 40), None, "a") for k in range(400)] + [(k, words(20 + k, k), "en", "b" if k % 2 else "a") for k in range(40)] + [(7, None, None, "c"), (8, "", None, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(4)
    for table in (df, docs):
        got = mixing.mix(table).collect()
        assert Counter((r.doc_id, r.size, r.source) for r in got) == Counter((r.doc_id, len((r.text or "").split()), r.source) for r in table.select("doc_id", "text", "source").collect())
        for source in {r.source for r in got}:
            own = [r for r in got if r.source == source]
            assert abs(sum(r.copies * r.size for r in own) - own[0].target) <= max(r.size for r in own) and max(r.copies for r in own) <= 2
        taken = mixing.taken_rows(table)
        assert taken.columns == table.columns and taken.count() == sum(r.copies for r in got)
        assert Counter((r.doc_id, r.source) for r in taken.collect()) == sum((Counter({(r.doc_id, r.source): r.copies}) for r in got if r.copies), Counter())
        assert taken.select("doc_id", "text").exceptAll(mixing.taken_rows(table.repartition(2)).select("doc_id", "text")).count() == 0


def place(text):
    """Where a text stands among those of its doc_id: by the hash that deals them, then by itself."""
    text = (text or "").encode()
    return xxhash.xxh64_intdigest(text, 42) % 1024, text


def voted(text):
    """The fingerprint of a text by its definition: signed votes of each adjacent pair of words."""
    w = re.split(r"[\x20\x09-\x0D]+", f" {(text or '').lower()} ")
    votes = [0] * 64
    for a, b in zip(w, w[1:]):
        h = xxhash.xxh64_intdigest(b.encode(), xxhash.xxh64_intdigest(a.encode(), 42))
        votes = [v + (len(a) + len(b)) * (1 if h >> k & 1 else -1) for k, v in enumerate(votes)]
    return sum(1 << k for k, v in enumerate(votes) if v > 0)


def test_simhash_of_odd_rows(docs):
    rows = pairs_of(docs)
    order = sorted({d for d, _ in rows if d is not None}, reverse=True) + [None]
    of = {d: [t or "" for x, t in rows if x == d] for d in order}
    got = {}
    for r in simhash.edit_test(docs).collect():
        got.setdefault(r.doc_id, []).append(r)
    value, edited = {}, {}
    for k, d in enumerate(order):
        after = order[(k + 1) % len(order)]
        starts = {min(of[after], key=place)}
        wanted = []
        for t in of[d]:
            value[t] = value.get(t) or voted(t)
            n = len(t) // 3
            wanted.append({hashlib.sha256((t[: len(t) - n] + x[:n]).encode()).hexdigest(): t[: len(t) - n] + x[:n] for x in starts})
        assert sorted(r.fingerprint for r in got[d]) == sorted(f"{value[t]:016x}" for t in of[d]) and sorted(r.n_chars for r in got[d]) == sorted(map(len, of[d]))
        for r in got[d]:
            text = next(w[r.edited_sha256] for w in wanted if r.edited_sha256 in w)
            edited[text] = edited.get(text) or voted(text)
            assert int(r.edited_fingerprint, 16) == edited[text]
            assert r.near_edited == 1 - (int(r.fingerprint, 16) ^ edited[text]).bit_count() / 64


def test_fertility_measures(docs):
    import math

    from sentencepiece import SentencePieceProcessor

    import public_tokenizers
    import tiktoken

    pieces, ranks = fertility.default_vocabularies()
    model = SentencePieceProcessor(model_file=pieces)
    tokens = [base64.b64decode(x.split()[0]) for x in open(ranks, "rb")]
    coding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: k for k, t in enumerate(tokens)}, special_tokens={})

    def whole(token):
        try:
            return bool(token.decode()) or True
        except UnicodeDecodeError:
            return False

    texts = dict(pairs_of(docs.where("doc_id is not null and doc_id <> 9 and length(text) < 100000")))
    for r in fertility.measure(docs.where("doc_id is not null and doc_id <> 9 and length(text) < 100000"), bands=fertility.BANDS).collect():
        w = (texts[r.doc_id] or "").split()
        ids = [i for x in w for i in model.encode(x)]
        shares = [n / len(ids) for n in Counter(ids).values()]
        assert r.n_symbols == sum(c in "#*$%&|<>" for c in texts[r.doc_id] or "") and r.n_tokens == len(ids)
        assert r.chars_per_token == pytest.approx(sum(map(len, w)) / max(len(ids), 1))
        assert r.byte_share == pytest.approx(sum(map(model.is_byte, ids)) / max(len(ids), 1)) and r.token_entropy == pytest.approx(-sum(x * math.log2(x) for x in shares))
        ids = [i for x in w for i in coding.encode_ordinary(" " + x)]
        shares = [n / len(ids) for n in Counter(ids).values()]
        assert r.n_tokens_2 == len(ids) and r.chars_per_token_2 == pytest.approx(sum(map(len, w)) / max(len(ids), 1)) and r.tokens_per_word_2 == pytest.approx(len(ids) / max(len(w), 1))
        assert r.byte_share_2 == pytest.approx(sum(not whole(tokens[i]) for i in ids) / max(len(ids), 1)) and r.token_entropy_2 == pytest.approx(-sum(x * math.log2(x) for x in shares))
        assert r.kept == (not r.base_failed and fertility.verdict(r.script, None, r.n_tokens, r.chars_per_token, r.byte_share, r.token_entropy, fertility.BANDS))


def test_language_scores_by_direct_convolution():
    rng = np.random.default_rng(1)
    net = language_id.Network(["a", "b", "c"], tuple(rng.normal(size=(65536, 36)).astype(np.float32) for _ in "ab"), *(rng.normal(size=s).astype(np.float32) for s in (36, (36, 3), 3)))
    texts = [b"", b"x", words(9, 1).encode(), words(200, 2).encode(), bytes(rng.integers(0, 255, 500, dtype=np.uint8))]
    offsets = np.cumsum([0, *map(len, texts)])
    got = language_id.scores(net, np.frombuffer(b"".join(texts), np.uint8), offsets)
    for text, row in zip(texts, got):
        logs = []
        for at in range(0, max(len(text), 1), language_id.WINDOW):
            x = text[at : at + language_id.WINDOW + 3].ljust(language_id.WINDOW + 3, b" ")
            answers = [[net.pairs[0][x[p] * 256 + x[p + 1], f] + net.pairs[1][x[p + 2] * 256 + x[p + 3], f] for f in range(36)] for p in range(language_id.WINDOW)]
            hidden = [max(0.0, max(a[f] for a in answers) + net.bias[f]) for f in range(36)]
            logit = np.array(hidden) @ net.weights + net.shift
            logs.append(logit - np.log(np.exp(logit - logit.max()).sum()) - logit.max())
        wanted = np.exp(np.mean(logs, axis=0))
        assert row == pytest.approx(wanted / wanted.sum(), rel=1e-3, abs=1e-6)


def test_fertility_base(spark, docs):
    text = {r.doc_id: r.text or "" for r in docs.collect() if r.doc_id is not None and r.doc_id != 9}
    for r in fertility.measure(docs).where("doc_id is not null and doc_id <> 9").collect():
        w = fertility.WORDS.findall(text[r.doc_id])
        seen = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        hit = {k + j for k in range(len(w) - 7) if seen[tuple(w[k : k + 8])] > 1 for j in range(8)}
        lines = [x for x in text[r.doc_id].split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        assert (r.n_words, r.word_chars, r.n_repeat_words, r.n_dup_lines) == (len(w), sum(map(len, w)), len(hit), len(lines) - len(set(lines)))
        assert r.base_failed == (len(w) < 20 or 100 * len(hit) > 30 * len(w)) and (not r.kept or not r.base_failed)


def test_fertility_bands_from_the_documents(spark):
    common = "the of and to in is that for it as was with be by on not he his but at are this have from or had an they which one you were all her she there would their we him been has when who will no more if out so said what up its about than into them can only other time new some could these two may first then do any like my now over such our man me even most made after also did many off before must well back through years much where your way down should because long each just state those people too mr how little good world make very year still see work life men without place great again home under old day same".split()
    rng = random.Random(4)
    prose = [(k, " ".join(rng.choices(common, k=rng.randint(100, 150))), "en") for k in range(200)]
    letters = [(1000 + k, " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=8)) for _ in range(30 + k)), "en") for k in range(3)]
    cluttered = [(2000 + k, " | ".join("".join(rng.choices("QXZJKVWY", k=3)) for _ in range(40)), "en") for k in range(3)]
    few_words = [(3000, " ".join(w for x in rng.sample(common, 8) for w in [x] * 15), "en")]
    unlabelled = [(4000 + k, t, None) for k, (_, t, _) in enumerate([*prose[:2], *letters[:2]])]
    df = spark.createDataFrame([*prose, *letters, *cluttered, *few_words, *unlabelled], "doc_id long, text string, lang string").repartition(3)
    rows = {r.doc_id: r for r in fertility.measure(df).collect()}
    kept = {d for d, r in rows.items() if r.kept}
    assert kept == {*range(200), 4000, 4001}
    assert all(not rows[d].base_failed for d in (1000, 1001, 1002, 4002, 4003))
    assert {r.doc_id for r in fertility.measure(df, bands=fertility.BANDS).where("kept").collect()} >= kept | {1000}


PROSE = {
    "latin": "All human beings are born free and equal in dignity and rights. They are endowed with reason and conscience and should act towards one another in a spirit of brotherhood",
    "cyrillic": "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью и должны поступать в отношении друг друга в духе братства",
    "greek": "Όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι στην αξιοπρέπεια και τα δικαιώματα. Είναι προικισμένοι με λογική και συνείδηση",
    "arabic": "يولد جميع الناس أحرارا متساوين في الكرامة والحقوق وقد وهبوا عقلا وضميرا وعليهم أن يعامل بعضهم بعضا بروح الإخاء",
    "hebrew": "כל בני האדם נולדו בני חורין ושווים בערכם ובזכויותיהם כולם חוננו בתבונה ובמצפון לפיכך חובה עליהם לנהוג איש ברעהו ברוח של אחווה",
    "han": "人人生而自由,在尊严和权利上一律平等。他们赋有理性和良心,并应以兄弟关系的精神相对待。人人有资格享有本宣言所载的一切权利和自由",
    "kana": "すべての人間は、生まれながらにして自由であり、かつ、尊厳と権利とについて平等である。人間は、理性と良心とを授けられており",
    "hangul": "모든 인간은 태어날 때부터 자유로우며 그 존엄과 권리에 있어 동등하다 인간은 천부적으로 이성과 양심을 부여받았으며",
    "thai": "มนุษย์ทั้งหลายเกิดมามีอิสระและเสมอภาคกันในเกียรติศักดิ์และสิทธิ ต่างมีเหตุผลและมโนธรรม และควรปฏิบัติต่อกันด้วยเจตนารมณ์แห่งภราดรภาพ",
    "indic": "सभी मनुष्यों को गौरव और अधिकारों के मामले में जन्मजात स्वतन्त्रता और समानता प्राप्त है उन्हें बुद्धि और अन्तरात्मा की देन प्राप्त है",
    "armenian": "Բոլոր մարդիկ ծնվում են ազատ ու հավասար իրենց արժանապատվությամբ ու իրավունքներով նրանք ունեն բանականություն ու խիղճ",
    "other": "ყველა ადამიანი იბადება თავისუფალი და თანასწორი თავისი ღირსებითა და უფლებებით მათ მინიჭებული აქვთ გონება და სინდისი",
}


def test_fertility_sizes_with_few_texts_take_neighbours_in(spark):
    """80 texts of prose in one size class judge random words in others; prose of other sizes stays, and its place among few or many is no matter."""
    prose = PROSE["latin"].split() * 400
    rng = random.Random(12)
    said = lambda n: " ".join(rng.choices(prose, k=n))
    rows = [(k, said(rng.randint(140, 200)), "en") for k in range(80)] + [(100 + k, said(n), "en") for k, n in enumerate((30, 45, 90, 320, 700, 3000, 20_000))]
    rows += [(1000 + k, " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=8)) for _ in range(n)), "en") for k, n in enumerate((25, 60, 400, 5000))]
    rows += [(2000, "", "en"), (2001, None, None)]
    got = {r.doc_id for r in fertility.measure(spark.createDataFrame(rows, "doc_id long, text string, lang string")).where("kept").collect()}
    assert got == {d for d, _, _ in rows if d < 1000}


@pytest.mark.parametrize("vocabulary", [0, 1])
@pytest.mark.parametrize("script", sorted(PROSE))
def test_fertility_fixed_bands_keep_prose_and_reject_junk(script, vocabulary):
    def fits(text):
        path = fertility.default_vocabularies()[vocabulary]
        m = [c[0].as_py() for c in fertility._measured([text], fertility._pieces(path))]
        assert m[5] == script
        return fertility.verdict(script, None, m[6], m[7], m[9], m[10], fertility.fixed_bands(path))

    assert fits(PROSE[script])
    letter = next(c for c in PROSE[script] if ord(c) > 0x40 and c.isalpha())
    assert not fits(" ".join([letter * 3 + PROSE[script].split()[0][:1]] * 60))


def test_repeat_words_counts_windows():
    numbers = np.array([*range(8), *range(8), 99, *range(4)])
    assert fertility.repeat_words(numbers, np.array([0, len(numbers)])).tolist() == [16]
    assert fertility.repeat_words(numbers, np.array([0, 8, len(numbers)])).tolist() == [0, 0]


def test_simhash_edits_and_radius(spark):
    rows = sorted(texts_of(spark), reverse=True)
    got = {r.doc_id: r for r in queries.op2_simhash(spark, SF).collect()}
    value = {d: int(r.fingerprint, 16) for d, r in got.items()}
    for k, (d, t) in enumerate(rows):
        n, after = len(t), rows[(k + 1) % len(rows)]
        edited = t[: n - n // 3] + after[1][: n // 3]
        assert got[d].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and got[d].n_chars == n
        assert got[d].near_next == 1 - (value[d] ^ value[after[0]]).bit_count() / 64
        assert got[d].n_near == (sum((value[d] ^ x).bit_count() <= 3 for x in value.values()) if d % 50 == 0 else None)


def test_rows_of_one_id_are_many_tasks(spark):
    """Half of all rows have one doc_id: neither operator sorts or joins them in one task, and the results are whole."""
    rows = [(7, words(30, k)) for k in range(300)] + [(100 + k, words(30, k)) for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    held = [r["n"] for r in numbered(df).withColumn("task", F.spark_partition_id()).where("key = 7").groupBy("task").agg(F.count("*").alias("n")).collect()]
    assert sum(held) == 300 and max(held) < 150
    assert Counter(map(tuple, suffix_dedup.span_digests(df).collect())) == repeats(rows)
    assert simhash.edit_test(df).count() == 600


def test_radius_finds_all(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(64) - (1 << 63) for _ in range(30)]
    all_of = [b ^ sum(1 << k for k in rng.sample(range(63), rng.randint(0, 5))) for b in base for _ in range(10)]
    df = spark.createDataFrame([(x,) for x in all_of], "fingerprint long")
    got = {(r.query, r.fingerprint) for r in simhash.within_radius(df, df.limit(40)).collect()}
    asked = {r.fingerprint for r in df.limit(40).collect()}
    assert got == {(q, x) for q in asked for x in all_of if ((q ^ x) & ((1 << 64) - 1)).bit_count() <= 3}


def repeats(rows, length=100):
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of each row by brute force; rows of one doc_id by place."""
    seen, out = set(), Counter()
    for d, t in sorted(rows, key=lambda r: (r[0] is None, r[0], place(r[1]))):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1 if d is not None else 0):
            w = b[s : s + length]
            if w in seen:
                gone[s : s + length] = b"\1" * length
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out[d, len(b), sum(gone), len([1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1])]), hashlib.sha256(kept).hexdigest()] += 1
    return out


def test_suffix_dedup(spark):
    rows = texts_of(spark)
    got = Counter(map(tuple, suffix_dedup.span_digests(spark.read.parquet(f"{SF}/documents.parquet")).collect()))
    assert got == repeats(rows)
    odd = [(1, "a" * 500), (2, "b" * 99), (3, "ab" * 200 + "a" * 150), (4, "a" * 500 + "ab" * 60), (5, words(60, 9)), (6, words(60, 9)[7:] + words(60, 9)[:200]), (7, "")]
    got = Counter(map(tuple, suffix_dedup.span_digests(spark.createDataFrame(odd, "doc_id long, text string")).collect()))
    assert got == repeats(odd)


def test_suffix_dedup_of_a_passage_that_most_documents_hold(spark):
    passage, rng = words(200, 70), random.Random(8)
    cut = lambda: passage[rng.randint(0, 200) : rng.randint(500, 900)] if rng.random() < 0.3 else passage
    rows = [(k, words(12, 100 + k) + " " + cut() + " " + words(rng.randint(0, 30), 300 + k) + (" " + passage if k % 7 == 0 else "")) for k in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = Counter(map(tuple, suffix_dedup.span_digests(df).collect()))
    assert got == repeats(rows)


def test_suffix_dedup_of_an_anchor_with_too_many_surroundings_to_hold(spark):
    passage, rng = words(40, 71), random.Random(9)
    rows = [(rng.randint(0, 80), words(9, 500 + k) + " " + passage + " " + words(rng.randint(0, 25), 700 + k) + (" " + passage if k % 9 == 0 else "")) for k in range(150)]
    rows = list({d: (d, t) for d, t in rows}.values())
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for block in (1, 10, suffix_dedup.BLOCK):
        assert Counter(map(tuple, suffix_dedup.span_digests(df, block=block).collect())) == repeats(rows)


def hot_anchor(n, size=1000):
    """n rows of one anchor, sorted, each with other bytes to the left, and 5 of another; in batches of `size`."""
    import pyarrow as pa

    contexts = [b"%060d" % k + b"x" * 100 for k in range(n)] + [b"%060d" % k + b"y" * 100 for k in range(5)]
    total = len(contexts)
    columns = [np.array([7] * n + [8] * 5), np.arange(total), *(np.full(total, v, np.int32) for v in (0, 60, 60, 0))]
    rows = pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(contexts, pa.binary())], names=["h", "key", "nth", "a", "back", "near", "context"])
    return [rows.slice(k, size) for k in range(0, total, size)]


def test_a_hot_anchor_is_not_held():
    passed = sum(len(x) - x.column("context").null_count for x in suffix_dedup._spans(100, 3000)(iter(hot_anchor(20_000))))
    assert passed == 20_000


def test_deep_shallow_order():
    rng = np.random.default_rng(3)
    rows = rng.integers(0, 2, (300, 60), dtype=np.uint8)
    rows[100:200] = rows[100]
    rows[150:, 55:] = 1
    group = np.sort(rng.integers(0, 3, 300))
    order, common = suffix_dedup.deep_shallow(rows, group)
    want = sorted(range(300), key=lambda k: (group[k], rows[k].tobytes()))
    assert [(group[k], rows[k].tobytes()) for k in order] == [(group[k], rows[k].tobytes()) for k in want]
    for k in range(1, 300):
        a, b = rows[order[k - 1]], rows[order[k]]
        assert common[k] == (-1 if group[order[k]] != group[order[k - 1]] else next((j for j in range(60) if a[j] != b[j]), 60))


def components_of(rows, width, percent):
    """(n_shingles, component_id) of each row, in order, by brute force: rows of one doc_id and rows whose sets are alike are linked."""
    sets = [{tuple(w[j : j + width]) for j in range(max(1, len(w) - width + 1))} if w else set() for w in ((t or "").lower().split() for _, t in rows)]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    named = [k for k, (d, _) in enumerate(rows) if d is not None]
    for n, a in enumerate(named):
        for b in named[n + 1 :]:
            if rows[a][0] == rows[b][0] or (sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])):
                root[find(b)] = find(a)
    least = {}
    for k in named:
        least[find(k)] = min(rows[k][0], least.get(find(k), rows[k][0]))
    return [(d, len(sets[k]), least[find(k)] if d is not None else None) for k, (d, _) in enumerate(rows)]


def found_components(spark, rows, width, percent):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return Counter((r.doc_id, r.n_shingles, r.component_id) for r in minhash.near_duplicates(df, width, percent).collect())


def edited(base, edits, rng, own=10**6):
    t = base[:]
    for _ in range(edits):
        t[rng.randrange(len(t))] = f"w{rng.randrange(own)}"
    return " ".join(t)


def test_minhash_hot_groups(spark):
    """Near copies around the threshold; and a family in which each pair is a little below it, with few words to choose from."""
    rng = random.Random(2)
    base, other = words(150, 8).split(), words(150, 9).split()
    rows = [(k, edited(base, rng.randint(0, 6), rng)) for k in range(150)] + [(k, edited(other, rng.randint(7, 12), rng, 30)) for k in range(1000, 1150)]
    assert found_components(spark, rows, 3, 85) == Counter(components_of(rows, 3, 85))


def test_minhash_rows_of_one_id_and_very_long_documents(spark):
    a, b, c = words(200, 20).split(), words(200, 21).split(), words(200, 22).split()
    rng = random.Random(3)
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, edited(a, 2, rng)), (3, edited(b, 2, rng)), (5, edited(c, 1, rng)), (4, " ".join(c)), (4, " ".join(c)), (9, edited(b, 3, rng)), (9, edited(c, 2, rng)),
            (None, " ".join(a)), (None, None), (7, ""), (8, " \n"), (8, "one"), (10, "One"), (11, "one two")]
    assert found_components(spark, rows, 3, 85) == Counter(components_of(rows, 3, 85))
    long = [f"x{k}" for k in range(250_000)]
    n = 250_000 - 4
    shared = -(-80 * 2 * n // 180)  # so many of n shingles each make a similarity of 0.8 or just more
    near = long[: shared + 4] + [f"y{k}" for k in range(n - shared)]
    far = long[: shared + 1] + [f"z{k}" for k in range(n - shared + 3)]  # two shingles fewer
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame([(1, " ".join(long)), (2, " ".join(near)), (3, " ".join(far))], "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


def test_minhash_recall_just_above_the_threshold(spark):
    rng, rows = random.Random(6), []
    for k in range(400):
        base = words(120, 5000 + k).split()
        rows += [(2 * k, " ".join(base)), (2 * k + 1, edited(base, rng.choice([2, 3]), rng))]
    sets = [{tuple(w[j : j + 3]) for j in range(118)} for w in (t.split() for _, t in rows)]
    wanted = {k for k in range(400) if 0.85 <= len(sets[2 * k] & sets[2 * k + 1]) / len(sets[2 * k] | sets[2 * k + 1]) < 0.9}
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()}
    assert len(wanted) > 100 and all(got[2 * k + 1] == 2 * k for k in wanted)


def test_permutations_are_one_to_one():
    assert len(np.unique(minhash.second_permutation(np.arange(1 << 16, dtype=np.uint32)))) == 1 << 16


def test_shards_merge_and_keep_every_row(spark):
    table = compaction.ShardTable(spark, shared_dir(spark, "t"), fan_in=2)
    rows = spark.range(100).withColumn("part", F.col("id") % 5)
    assert table.append_each(rows, "part") > 5
    assert len(table.manifest()["runs"]) < 5 and sum(r["rows"] for r in table.manifest()["runs"]) == 100
    assert sorted(r.id for r in table.read().collect()) == list(range(100))
    now = table.manifest()
    assert not table._commit(now["version"], [], now["schema"]) and table.manifest() == now
    assert sorted(r.id for r in table.read(1).collect()) == list(range(0, 100, 5))  # merging deletes nothing
    with pytest.raises(ValueError):
        compaction.ShardTable(spark, shared_dir(spark, "t")).read()


def test_shards_of_odd_and_empty_tables(spark, docs):
    table = compaction.ShardTable(spark, shared_dir(spark, "t"), fan_in=3)
    table.append_each(docs.limit(0).withColumn("arrival", F.lit(1)), "arrival")
    assert table.read().collect() == [] and table.read().columns == docs.columns
    table.append_each(docs.withColumn("arrival", F.col("doc_id") % 4), "arrival")
    assert table.read().exceptAll(docs).count() == docs.exceptAll(table.read()).count() == 0


def test_shards_arrive_in_order_and_are_vacuumed(spark):
    table = compaction.ShardTable(spark, shared_dir(spark, "t"), fan_in=100)
    table.append_each(spark.range(24).withColumn("part", F.col("id") % 12), "part")
    assert [r["folder"].rsplit("=")[-1] for r in table.manifest()["runs"]] == [str(k) for k in range(12)]
    spark.range(3).write.parquet(f"{table.path}/data/of-a-dead-writer")
    assert table.vacuum() == []  # too young
    table.fan_in = 12
    table.compact()
    assert len(table.vacuum(keep_versions=1, grace_seconds=-60)) == 2 and table.versions() == [13]
    assert sorted(r.id for r in table.read().collect()) == list(range(24))


def test_warc_segments_revisits_and_errors(spark):
    big = words(9000, 3)
    rows = [(5, "u", big), (2, "http://a b/\r\n", big), (7, None, None), (9, "u", "small"), (10, "u", "small"), (None, "n", big), (2, "again", big), (11, "u", "WARC/1.1\r\n\r\n\r\n" * 50)]
    path = shared_dir(spark, "w")
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), path, records_per_file=2)
    got = warc.read_archives(spark, path).collect()
    assert all(r.error is None for r in got)
    assert Counter((r.page_id, (r.payload or b"").decode(), r.record_type, r.refers_to) for r in got) == Counter(
        (p, h or "", "revisit" if h == big and p != 2 else "response", 2 if h == big and p != 2 else None) for p, _, h in rows
    )
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), path + "-none")
    assert warc.read_archives(spark, path + "-none").collect() == []
    assert warc.unchunked(b"3;x=y\r\nabc\r\n0\r\nT: 1\r\n\r\n") == b"abc"
    with pytest.raises(ValueError):
        warc.unchunked(b"5\r\nabc\r\n0\r\n\r\n")


def test_warc_headers_that_are_no_numbers(spark, tmp_path):
    record = lambda n, size, extra="": f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <{n}>\r\nWARC-Page-ID: {n}\r\n{extra}Content-Length: {size}\r\n\r\nH\r\n\r\nab\r\n\r\n"
    (tmp_path / "a.warc").write_text(record(1, 7) + record(2, "x") + record(3, 7, "WARC-Segment-Number: one\r\n") + record("p", 7) + record(4, 7), newline="")
    got = sorted((r.record_id, r.page_id, r.error, (r.payload or b"").decode()) for r in warc.read_archives(spark, str(tmp_path)).collect())
    assert got == [("<1>", 1, None, "ab"), ("<2>", None, "header: content-length", ""), ("<3>", 3, "header: warc-segment-number", ""), ("<4>", 4, None, "ab"), ("<p>", None, "header: warc-page-id", "")]


def test_warc_of_one_payload_in_most_pages(spark):
    rows = [(None if k % 5 == 0 else k, f"u{k % 7}", "x" * 200 if k % 3 else str(k)) for k in range(3000)]
    path = shared_dir(spark, "w")
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), path)
    got = warc.read_archives(spark, path).collect()
    assert Counter((r.page_id, r.payload.decode(), r.refers_to, r.error) for r in got) == Counter((p, h, 1 if len(h) == 200 and p != 1 else None, None) for p, _, h in rows)


def test_bpe_equals_the_library(spark, docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.default_vocabulary())
    for r in bpe.decode(bpe.encode(docs)).collect():
        assert r.ids == library.encode(r.text or "", add_special_tokens=False).ids and r.decoded == (r.text or "")
    got = {r.doc_id: r for r in queries.op7_bpe(spark, SF).collect()}
    for d, t in texts_of(spark):
        ids = library.encode(t, add_special_tokens=False).ids
        assert got[d].n_tokens == len(ids) and got[d].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[d].decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_mixing_targets(spark):
    got = mixing.mix(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()
    taken, target, largest = Counter(), {}, Counter()
    for r in got:
        taken[r.source] += r.copies * r.size
        target[r.source] = r.target
        largest[r.source] = max(largest[r.source], r.size)
        assert 0 <= r.copies <= 2
    assert sum(target.values()) == pytest.approx(1.5 * sum(r.size for r in got))
    assert all(abs(taken[s] - t) <= largest[s] for s, t in target.items())  # in order of size, the sums differ by one document at most


def test_language_id_held_out(spark):
    path = "/root/testdata/sf0.01"
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "lang").collect()}
    got = queries.op10_language_id(spark, path).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) / len(held) > 0.97


def test_no_letter_is_und(spark, docs):
    got = {r.doc_id: r.lang_pred for r in language_id.predict(docs, language_id.fit(docs, per_lang=5)).collect()}
    assert got[12] == got[15] == got[18] == got[36] == "und" and got[0] == "en"


def identified(docs, pipeline):
    """The rows that the language stage keeps, decided in plain Python from the network's predictions."""
    net = language_id.fit(docs.where(~language_id.held_out_of(F.col("doc_id"))))
    rows = language_id.predict(docs.withColumn("held", language_id.held_out_of(F.col("doc_id"))), net).collect()
    right = {}
    for r in rows:
        if r.held and r.lang == r.lang_pred:
            right.setdefault(r.lang, []).append(r.score)
    at = lambda lang, q, default: sorted(right[lang])[max(math.ceil(q * len(right[lang])), 1) - 1] if lang in right else default
    guess, out = 1 / len(net.labels), Counter()
    for r in rows:
        low = r.lang_pred == "und" or r.score < (at(r.lang_pred, pipeline.TAIL, guess) + guess) / 2
        other = r.lang in net.labels and r.lang != r.lang_pred and r.score >= max(at(r.lang_pred, pipeline.CONTRADICTED, 1.0), pipeline.SURE)
        if not low and not other:
            out[r.doc_id, r.text, r.lang or r.lang_pred] += 1
    return out


def assert_mixed(rows, copies, weights=(3, 1, 2), share=1.5, most=2.0):
    """copies of each of rows (source, text): each near its expectation, and so is each stretch of a source in order of size."""
    sizes = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t in rows]
    of = {}
    for k, (source, _) in enumerate(rows):
        of.setdefault(source, []).append(k)
    weight = {s: weights[k % 3] for k, s in enumerate(sorted(of, key=lambda s: (s is None, s or "")))}
    total = {s: sum(sizes[k] for k in of[s]) for s in of}
    target, rest, left = {}, share * sum(sizes), {s for s in of if total[s]}
    while left:
        each = {s: rest * weight[s] / sum(weight[x] for x in left) for s in left}
        full = [s for s in left if each[s] > most * total[s]]
        target |= {s: most * total[s] for s in full} or each
        rest, left = rest - sum(most * total[s] for s in full), left - set(full) if full else set()
    for s in target:
        expected, seen, ends = target[s] / total[s], 0.0, [0.0]
        own = sorted(of[s], key=sizes.__getitem__)
        for k, after in zip(own, [*own[1:], None]):
            assert copies[k] in (math.floor(expected + 1e-9), math.ceil(expected - 1e-9))
            seen += copies[k] - expected
            if after is None or sizes[after] != sizes[k]:  # the order of equal sizes isn't told
                ends.append(seen)
        assert max(ends) - min(ends) < 1 + 1e-6
        assert abs(sum(copies[k] * sizes[k] for k in own) - target[s]) <= max(sizes[k] for k in own)


def test_pipeline_stages(spark):
    """Each stage, row by row, against plain Python on the rows that it was given."""
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    names = docs.columns
    rows = [r.asDict() for r in docs.collect()]
    said = {r["lang"]: r["text"] for r in rows if r["lang"] and len(r["text"]) > 1500}
    line, base = "this very line stands in two documents", words(80, 1)
    planted = [(None, "no doc id " + base), (10_001, None), (10_002, "12 34 !!"), (10_003, line + "\n" + words(30, 2)), (10_004, words(30, 3) + "\n" + line), (10_005, line), (10_006, base), (10_007, base + " x")]
    rows += [{"doc_id": d, "text": t, "lang": "en", "source": "planted", "n_chars": 0} for d, t in planted]
    german = [r["text"] for r in rows if r["lang"] == "de" and len(r["text"]) > 1500][:4]
    rows += [{"doc_id": 10_100 + k, "text": t, "lang": "fr", "source": None, "n_chars": 0} for k, t in enumerate(german)] + [{"doc_id": 10_009, "text": said["de"][-1400:], "lang": None, "source": None, "n_chars": 0}]
    before = spark.createDataFrame([tuple(r[c] for c in names) for r in rows], docs.schema)
    stages = dict(pipeline.STAGES)

    def step(name):
        found = stages[name](spark, before, SF)
        rows = found.collect()
        return rows, spark.createDataFrame(rows, found.schema)

    after, table = step("language_id")
    by_id = {r.doc_id: r for r in after}
    assert Counter((r.doc_id, r.text, r.lang) for r in after) == identified(before, pipeline)
    assert {10_001, 10_002}.isdisjoint(by_id) and sum(10_100 + k in by_id for k in range(4)) <= 2  # labelled as French
    assert by_id[10_009].lang == "de" and table.columns == names
    assert {r["doc_id"] for r in rows if r["doc_id"] is not None and r["doc_id"] < 10_000 and len(r["text"]) > 100} - set(by_id) == set()
    rows = [r for r in after if r.doc_id is None or r.doc_id < 150 or 10_000 < r.doc_id < 10_100]  # brute force takes long
    before = spark.createDataFrame(rows, table.schema)
    after, table = step("line_dedup")
    left = ["\n".join(x) for x in lines_left([(r.doc_id, r.text) for r in rows])]
    assert Counter((r.doc_id, r.text, r.n_chars) for r in after) == Counter((r.doc_id, t, len(t)) for r, t in zip(rows, left) if t.split())
    assert table.columns == names and 10_005 not in {r.doc_id for r in after}
    before, rows = table, after
    after, table = step("near_duplicates")
    first = {c for _, _, c in components_of([(r.doc_id, r.text) for r in rows], 5, 80)}
    assert Counter(map(tuple, after)) == Counter(tuple(r) for r in rows if r.doc_id is None or r.doc_id in first) and 10_007 not in {r.doc_id for r in after}
    before, rows = table, after
    after, table = step("mixing")
    copies = Counter(map(tuple, after))
    assert table.columns == names and set(copies) <= set(map(tuple, rows)) and max(copies.values()) <= 2
    assert len(set(map(tuple, rows))) == len(rows)
    assert_mixed([(r.source, r.text) for r in rows], [copies[tuple(r)] for r in rows])
    before, rows = table, after
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.default_vocabulary())
    ids = [(r.doc_id, library.encode(r.text, add_special_tokens=False).ids) for r in rows]
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert Counter(map(tuple, step("bpe")[0])) == Counter((d, len(x), sha(np.array(x, "<u4").tobytes()), sha(library.decode(x, skip_special_tokens=False).encode())) for d, x in ids)
    for stage in stages.values():
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_pipeline_run_is_its_stages(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in pipeline.STAGES:
        found = stage(spark, docs, SF)
        docs = spark.createDataFrame(found.collect(), found.schema)
    assert Counter(map(tuple, pipeline.run(spark, SF).collect())) == Counter(map(tuple, docs.collect()))
