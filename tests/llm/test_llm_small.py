"""Each operator on small fixtures against plain Python: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import collections
import hashlib
import io
import math
import random
import re
import string
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from seqloom.llm import bloom, chat_format, exact_dedup, lang_id, mixing, quality, rank_bpe, simhash, token_pack, toxicity, url_filter
from seqloom.session import shared_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
rnd = random.Random(7)
WORDS = ["".join(rnd.choice(string.ascii_lowercase) for _ in range(rnd.randint(2, 9))) for _ in range(300)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


LONG = prose(30_000, 99)
TEXTS = [None, "", " \n\t ", "a", "A", "One two three four five", "one TWO three four five", LONG, LONG, LONG.replace(LONG[:5], "zzzzz", 1), "é ü ß漢字 🙂", "x" * 70, "x" * 69 + "y", "X" * 70, *[prose(60, i) for i in range(6)], prose(60, 3)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 3 else None, ["s0", "s1", None][i % 3], None) for i, t in enumerate(TEXTS)]
    rows += [rows[5], (None, "no id", "en", "s0", 1), (None, None, None, None, None)]  # a repeated row, null ids
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def lower(t):
    return (t or "").encode().translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256)))


def fingerprint(t):
    w = lower(t).split()
    if not w:
        return 0
    s = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


# chat formatting


def test_chat_round_trip_and_machine(spark):
    bad = "<|im_end|>\\<|x\\\\ <\\|\n"
    rows = [
        (1, 1, "assistant", bad), (1, 0, "user", None), (2, 0, "user", "q"), (2, 0, "user", "q"), (3, 0, "we|ird\n<|r", "t"), (4, 0, "system", "s"),
        (None, 0, "user", "n"), (None, 1, "assistant", "m"), (5, 0, None, None),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("error", F.lit("own"))
    seg = chat_format.format_chats(df)
    got = {r.conv_id: r for r in chat_format.read_back(seg).collect()}
    assert got[1].turns_sha256 == hashlib.sha256(f"user\n\nassistant\n{bad}\n".encode()).hexdigest()
    assert got[1].loss_sha256 == hashlib.sha256(bad.encode()).hexdigest() and got[1].loss_chars == len(bad) and got[1].valid
    assert got[2].error == "turn 1: 'user' after asked" and got[2].n_turns == 2
    assert got[3].turns_sha256 == hashlib.sha256(b"we|ird\n<|r\nt\n").hexdigest() and not got[3].valid
    assert got[4].error == "ends told" and got[None].valid and got[5].n_turns == 1
    whole = {r.conv_id: r.formatted for r in chat_format.documents(seg).collect()}
    assert whole[1] == "<|im_start|>user\n<|im_end|>\n<|im_start|>assistant\n" + chat_format.escape(bad) + "<|im_end|>\n"
    assert {k: len(v) for k, v in whole.items()} == {k: v.formatted_chars for k, v in got.items()}
    assert all("<|" not in chat_format.escape(t) and chat_format.unescape(chat_format.escape(t)) == t for t in (bad, "<<||<|", "\\", "\\\\<|"))
    assert chat_format.read_back(chat_format.format_chats(df.where("false"))).count() == 0


# packed tokens


@pytest.mark.parametrize("bits", [1, 7, 8, 13, 16, 17, 31, 32])
def test_pack(bits):
    x = np.random.default_rng(bits).integers(0, 1 << bits, 999).astype("<u4")
    assert (token_pack.unpack(token_pack.pack(x, bits), len(x), bits) == x).all()
    assert len(token_pack.pack(x, bits)) == (len(x) * bits + 7) // 8


def test_file_random_access_and_damage():
    class Out(io.BytesIO):
        def close(self):
            self.data = self.getvalue()

    class Source(io.BytesIO):
        def size(self):
            return len(self.getvalue())

    docs = [np.arange(n, dtype="<u4") % 1000 for n in (0, 3, 5000, 1, 0, 12345, 7)]
    out = Out()
    w = token_pack.Writer(out, 1000, block=512)
    for i, d in enumerate(docs):
        w.add(None if i == 0 else i, d)
    w.close()
    r = token_pack.Reader(Source(out.data))
    assert r.bits == 10
    for k in [5, 0, 6, 2, 1, 4, 3]:
        assert (r.document(k) == docs[k]).all()
    assert r.nulls.tolist() == [True] + [False] * 6
    with pytest.raises(ValueError):
        token_pack.Reader(Source(out.data[:-40] + b"\0" * 5 + out.data[-35:]))


def test_token_files(spark, docs, empty):
    manifest = token_pack.write_token_files(docs, shared_path(spark, "tokens"), docs_a_file=5)
    rows = token_pack.read_token_files(manifest).orderBy("start").collect()
    enc = token_pack.encoder(token_pack.tokenizer_path()).tokenizer
    order = sorted(((r.doc_id is not None, r.doc_id or 0, (r.text or "").encode()) for r in docs.collect()))
    start = 0
    assert len(rows) == len(order)
    for r, (known, i, text) in zip(rows, order):
        ids = [*enc.encode(text.decode(), add_special_tokens=False).ids, 2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i if known else None, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert token_pack.read_token_files(token_pack.write_token_files(empty, shared_path(spark, "tokens"))).count() == 0


def test_pieces_encode_as_whole_texts():
    e = token_pack.encoder(token_pack.tokenizer_path())
    r = random.Random(3)
    texts = ["".join(r.choice("ab CD\n\t  's1é漢 \x1c,.!İΣ\u0301<|>") for _ in range(r.randint(0, 60))) for _ in range(1500)] + ["<|endoftext|>", "a<|endoftext|>.", "It's, don't."]
    assert [x.tolist() for x in e.encode(texts)] == [x.ids for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_words_encode_once_whatever_their_case_and_marks(monkeypatch):
    e = token_pack.PieceEncoder(token_pack.tokenizer_path())
    learned, learn = [], e._learn
    monkeypatch.setattr(e, "_learn", lambda new: (learned.extend(new), learn(new)))
    texts = [["tree été"], ["Tree, TREE!?\nÉté."], ["tree,  ÉTÉ!? don't.", ""]]
    for t in texts:
        assert [x.tolist() for x in e.encode(t)] == [x.ids for x in e.tokenizer.encode_batch(t, add_special_tokens=False)]
    assert sorted(learned) == sorted(["tree", "été", ",", "!?", ".", "don't."])


def test_words_forgotten_and_learned_again(monkeypatch):
    monkeypatch.setattr(token_pack, "PIECES", 20)
    monkeypatch.setattr(token_pack, "SLICE", 3)
    e = token_pack.PieceEncoder(token_pack.tokenizer_path())
    r = random.Random(4)
    for _ in range(40):
        texts = ["".join(r.choice("abÉ tT., 1'\n") for _ in range(r.randint(0, 30))) for _ in range(8)] + ["x" * 100 + ".", "-" * 100]
        assert [x.tolist() for x in e.encode(texts)] == [x.ids for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]
        assert not any(len(k) > token_pack.LONG for k in e.number)
    assert len(e.bounds) < 200
    for kind in (pa.string(), pa.large_string()):
        assert [x.tolist() for x in e.encode(pa.array(["-", "Été, été", ""], kind).slice(1))] == [e.tokenizer.encode("Été, été", add_special_tokens=False).ids, []]


# byte-level BPE


def reference_encoding():
    import public_tokenizers
    import tiktoken

    b = rank_bpe.bpe(rank_bpe.ranks_path())
    return b, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=b.ranks, special_tokens={})


def test_bpe_equals_the_library():
    b, enc = reference_encoding()
    r = random.Random(1)
    texts = ["", "a  b", "a\n\n  b \n", "  x  y", "x" * 5000, "日本語テキスト 漢字", "a\x1cb \x1c c\x85 d", " ", "a ", "<|endoftext|>", LONG.replace(" ", "")[:20000]]
    texts += ["".join(r.choice("ab cd\n\t  's1é漢 \x1c\xa0") for _ in range(r.randint(0, 60))) for _ in range(1500)]
    for t in texts:
        ids = b.encode(t)
        assert ids == np.array(enc.encode_ordinary(t), "<u4").tobytes(), t[:80]
        assert b.decode(ids) == t.encode()


def test_merges_equal_least_rank_first_on_random_ranks(monkeypatch):
    """Ranks in any order, so that merges bring up lower ranks than their own; buckets merged at once or by position."""
    r = random.Random(4)
    for n in range(300):
        monkeypatch.setattr(rank_bpe, "MANY", (1, 3, 10**9)[n % 3])
        ranks = {bytes([c]): i for i, c in enumerate(b"abc")}
        more = list({bytes(r.choice(b"abc") for _ in range(r.randint(2, 5))) for _ in range(12)})
        ranks |= {t: 3 + i for i, t in enumerate(more)}
        b = rank_bpe.Bpe(ranks, r"[^x]+")
        pieces = [bytes(r.choice(b"abc") for _ in range(r.randint(1, 25))) for _ in range(r.randint(1, 12))]
        want = []
        for piece in pieces:
            parts = [piece[i : i + 1] for i in range(len(piece))]
            while options := [(ranks[parts[i] + parts[i + 1]], i) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in ranks]:
                _, i = min(options)
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            want.append(np.array([ranks[p] for p in parts], "<u4").tobytes())
        assert b.merge(pieces) == want
        assert [b.decode(w) for w in want] == pieces
    with pytest.raises(KeyError):
        b.merge([b"abz"])
    with pytest.raises(KeyError):
        b.decode(np.array([99], "<u4").tobytes())


def test_bpe_documents(spark, docs, empty):
    _, enc = reference_encoding()
    out = rank_bpe.decode_documents(rank_bpe.encode_documents(docs.withColumn("TOKEN_IDS", F.lit(1))))
    for r in out.collect():
        assert bytes(r.decoded) == (r.text or "").encode()
        assert np.frombuffer(r.token_ids, "<u4").tolist() == enc.encode_ordinary(r.text or "")
    assert out.columns == [*docs.columns, "token_ids", "decoded"] and out.count() == docs.count()
    assert rank_bpe.encode_documents(empty).count() == 0


# SimHash


def plain_components(fps, bits=4):
    label = list(range(len(fps)))
    find = lambda i: i if label[i] == i else find(label[i])
    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= bits:
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_fingerprints():
    texts = [*TEXTS, "A\x0bb\x0cc\rd", "ü " * 50]
    assert [int(x) for x in simhash.fingerprints(pa.array(texts))] == [fingerprint(t) for t in texts]
    assert [int(x) for x in simhash.fingerprints(pa.array(texts)[3:9])] == [fingerprint(t) for t in texts[3:9]]


def test_components_of_documents(spark, docs, empty):
    rows = docs.collect()
    fps = [fingerprint(r.text) for r in rows]
    label = plain_components(fps)
    low = collections.defaultdict(list)
    for r, c in zip(rows, label):
        if r.doc_id is not None:
            low[c].append(r.doc_id)
    want = sorted(map(str, ((r.doc_id, f, min(low[c]) if low[c] else None) for r, f, c in zip(rows, fps, label))))
    got = sorted(str((r.id, r.fp % (1 << 64), r.component_id)) for r in simhash.near_duplicates(docs).collect())
    assert got == want
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.drop_near_duplicates(docs.withColumn("dropped_id", F.lit(1)))
    assert kept.columns == [*docs.columns, "dropped_id"]
    assert {r.doc_id for r in kept.collect()} == {min(v) for v in low.values() if v} | ({None} if any(r.doc_id is None and not low[c] for r, c in zip(rows, label)) else set())


@pytest.mark.parametrize("limit", [simhash.CELL_LIMIT, 3])
def test_no_link_is_lost(spark, limit):
    """Chains and clusters of near fingerprints; with limit 3 cells overflow and go by midpoints."""
    r = random.Random(limit)
    fps = [0]
    for _ in range(25):
        f = r.getrandbits(64)
        for _ in range(r.randint(1, 6)):
            fps.append(f)
            for b in r.sample(range(64), r.randint(0, 6)):
                f ^= 1 << b
    fps = list(dict.fromkeys(fps))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    root = {x.node: x.root for x in simhash.components(simhash.link_forest(df, limit=limit)).collect()}
    label = plain_components(fps)
    groups = collections.defaultdict(set)
    mine = collections.defaultdict(set)
    for f, c in zip(fps, label):
        groups[c].add(f)
        mine[root.get(signed(f), signed(f))].add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, mine.values()))


def test_components_of_long_paths(spark):
    n = 60
    links = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    assert {r.node: r.root for r in simhash.components(links).collect()} == {**{i: 0 for i in range(1, n + 1)}, 101: 100}


# toxicity


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[-1] + 1))
        row = new
    return row[-1]


def test_automaton_equals_edit_distance():
    words, stems = ["idiot", "moron", "scum", "disgusting", "trash", "crash"], ["vequ", "lowei"]
    a = toxicity.TrieAutomaton(words, stems)
    r = random.Random(5)
    for _ in range(4000):
        w = list(r.choice([*words, "vequta", "vequ", "loweier", "house"]))
        for _ in range(r.randint(0, 3)):
            i = r.randint(0, len(w))
            w[i : i + r.randint(0, 1)] = r.choice(["", "a", "t", "o"])
        w = "".join(w)
        allowed = {t: 0 if len(t) < 5 else 1 if len(t) < 9 else 2 for t in words}
        near = [edits(w, t) for t in words if edits(w, t) <= allowed[t]] + [0 for s in stems if w.startswith(s) and w != s]
        got = a.match(w)
        assert (got[1] if got else None) == (min(near) if near else None), w


def test_toxicity_learns_terms_and_reads_context(spark, empty):
    r = random.Random(6)
    rows, labels = [], []
    for i in range(400):
        toxic = i % 4 == 0
        t = prose(80, i).split()
        if toxic:
            for _ in range(4):
                t.insert(r.randint(0, len(t)), r.choice(["idiot", "zork" + r.choice(["as", "en", "ito", "ly", "um"])]))
        elif i % 8 == 1:
            t[5:5] = "he said the word idiot was once used".split()
        rows.append((i, " ".join(t), "en", "s", 1))
        labels.append((i, 1, int(toxic)))
    docs = spark.createDataFrame(rows + [(None, None, None, None, None)], DOCS)
    lab = spark.createDataFrame(labels + [(3, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, lab, toxicity.learnable())
    assert any("zork".startswith(s) for s in model.stems)
    out = {x.doc_id: x for x in toxicity.score(docs.withColumn("Score", F.lit("own")), model).collect()}
    assert len(out) == 401 and all(0 <= x.score <= 1 for x in out.values())
    assert sum((out[i].score >= 0.5) != bool(t) for i, _, t in labels) <= 4
    assert out[None].score < 0.5
    assert toxicity.reject_toxic(docs, lab).columns == docs.columns
    many = docs.unionByName(docs.where("doc_id < 40")).unionByName(spark.createDataFrame([(9001, prose(60_000, 3) + " you idiot " * 3, None, None, None)], DOCS))
    assert toxicity.score(many, model).count() == 442 and toxicity.reject_toxic(many, lab).where("doc_id = 9001").count() <= 1
    assert toxicity.reject_toxic(empty, lab).count() == 0 and toxicity.reject_toxic(docs, lab.where("false")).count() > 0
    other = toxicity.train(docs.repartition(7).unionByName(docs), lab.repartition(3), toxicity.learnable())
    assert [other.score(r[1]) for r in rows] == [model.score(r[1]) for r in rows]
    plain = toxicity.train(empty, lab.where("false"))
    assert plain.words == toxicity.SEEDS and plain.score("") < 0.5 < plain.score("you idiot you absolute moron")
    assert plain.score('they said " idiot " is a word') < plain.score("you are an idiot here and now")
    assert toxicity.score(empty, plain).count() == 0


def test_stems_keep_words_and_seeds_and_edits():
    counts = [("scum", 30, 0), ("scumbag", 30, 0), ("scummy", 30, 0), ("scum*", 60, 0)]
    words, stems, _ = toxicity.choose_terms(counts, 100, 1000)
    assert stems == ["scum"] and set(words) == {"scum", "scumbag", "scummy"}
    model = toxicity.Model(words, stems, [3.0] * 4)
    assert all(model.score(f"you are {w} here") > model.score("nothing here") for w in ["scum", "scumbag", "scumbags", "scunbag"])
    stems = ["zorkas", "flim", "grumblers"]
    a = toxicity.TrieAutomaton([], stems, edit_stems=True)
    r = random.Random(11)
    for _ in range(2000):
        w = list(r.choice(["zorkasito", "zorkas", "flimsy", "grumblersome", "house"]))
        for _ in range(r.randint(0, 3)):
            i = r.randint(0, len(w))
            w[i : i + r.randint(0, 1)] = r.choice(["", "a", "s", "o"])
        w = "".join(w)
        near = [e for s, n in zip(stems, [1, 0, 2], strict=True) for i in range(len(w)) if (e := edits(w[:i], s)) <= n]
        got = a.match(w)
        assert (got[1] if got else None) == (min(near) if near else None), w


def test_seed_stays_beside_its_stem(spark):
    rows, labels = [], []
    for i in range(400):
        t = prose(40, i)
        if i % 4 == 0:
            t += " " + ["scumbag", "scummy", "scumlike"][i % 3]
        rows.append((i, t, "en", "s", 1))
        labels.append((i, 1, int(i % 4 == 0)))
    model = toxicity.train(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert any("scum".startswith(s) for s in model.stems) and "scum" in model.words
    assert model.score(prose(40, 1) + " scum") > model.score(prose(40, 1))


def test_only_near_copies_are_kept_from_learning(spark):
    passage, r = prose(30, 50), random.Random(51)
    own = lambda n: " ".join("".join(r.choice(string.ascii_lowercase) for _ in range(8)) for _ in range(n))
    rows = [(f"{passage} {own(40)}", 1) for _ in range(200)]
    assert toxicity.less_near_copies(spark.createDataFrame(rows, "text string, toxic int")).count() == 200
    base = own(100)
    rows = [(f"{base} {own(1)}", 1) for _ in range(200)] + [(base, 0)] * 5
    kept = [x.toxic for x in toxicity.less_near_copies(spark.createDataFrame(rows, "text string, toxic int")).collect()]
    assert 1 <= sum(kept) <= 10 and kept.count(0) == 1


def test_terms_joined_by_marks():
    model = toxicity.Model(["stupid", "idiot", "moron", "scum"], [], [3.0] * 4)
    model._ready()

    def hits(token):
        model._classify(token)
        return [(model.words[n], e) for n, e in model._hits.get(token, [])]

    for t in ["stupid$$$", "<stupid>", "@stupid", "/stupid=", "$tupid", "stup1d!!", "(stupid)", "stupid's"]:
        assert hits(t) == [("stupid", 0)], t
    assert hits("idiot/moron") == hits("idiot,moron") == hits("=idiot=moron$") == [("idiot", 0), ("moron", 0)]
    assert hits("idiot's") == [("idiot", 0)] and hits("***") == hits("12/34") == hits("well-known") == []
    clean = model.score("nothing at all here")
    assert all(model.score(f"nothing {t} here") > clean for t in ["stupid$$$", "idiot/moron", "idiot's"])
    assert model.features("idiot/moron here")[3] == math.log1p(2)


# language


def test_language(spark, docs, empty):
    r = random.Random(8)
    alphabet = {"aa": "abcdefgh", "bb": "ijklmnop", "cc": "éèêëîïôû"}
    rows = []
    for i in range(240):
        lang = ["aa", "bb", "cc"][i % 3]
        rows.append((i, " ".join("".join(r.choice(alphabet[lang]) for _ in range(5)) for _ in range(12)), lang, None, None))
    train = spark.createDataFrame(rows, DOCS)
    model = lang_id.train(train)
    out = lang_id.predict(train.withColumn("Score", F.lit(1)), model)
    assert out.where("lang <> lang_pred").count() == 0 and "Score" not in out.columns
    odd = spark.createDataFrame([(1, None, None, None, None), (2, "", None, None, None), (3, "123 !?", None, None, None), (4, "abc" * 200_000, None, None, None)], DOCS)
    got = {x.doc_id: (x.lang_pred, x.score) for x in lang_id.predict(odd, model).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0) and got[4][0] == "aa" and 0 <= got[4][1] <= 1
    assert {x.lang_pred for x in lang_id.predict(docs, lang_id.train(empty)).collect()} == {"und"}
    assert lang_id.predict(empty, model).count() == 0


def test_language_learns_once_from_copies(spark):
    r = random.Random(13)
    text = lambda letters: " ".join("".join(r.choice(letters) for _ in range(5)) for _ in range(12))
    rows = [(text("abcdefgh"), "aa") for _ in range(40)] + [(text("ijklmnop"), "bb") for _ in range(40)] + [(text("abcdefgh"), "aa")] * 300
    model = lang_id.train(spark.createDataFrame(rows, "text string, lang string"))
    assert model.landmarks.shape[1] == np.unique(model.landmarks, axis=1).shape[1] == 81


def test_language_sample_is_bounded_and_has_rare_languages(spark):
    """Half of the rows share one text, and a language has one row in 1,000; row order has no bearing."""
    r = random.Random(14)
    text = lambda letters: " ".join("".join(r.choice(letters) for _ in range(5)) for _ in range(12))
    rows = [(i, "abba " * 9 if i % 2 else text("abcdefgh"), "aa") for i in range(40_000)] + [(40_000 + i, text("ijklmnop"), "bb") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    picked = {x.lang: x["count"] for x in lang_id.sample_of(df.withColumnRenamed("doc_id", "id"), 400).groupBy("lang").count().collect()}
    assert picked["bb"] == 40 and 200 < picked["aa"] < 450
    a, b = lang_id.train(df, sample_rows=400), lang_id.train(df.repartition(5), sample_rows=400)
    probes = [t for _, t, _ in rows[::997]] + [t for _, t, _ in rows[-40:]]
    assert a.predict(probes) == b.predict(probes)
    assert a.predict(probes)[0] == ["aa"] * (len(probes) - 40) + ["bb"] * 40


def test_predictions_are_those_of_kernel_ridge():
    """With every text a landmark, Nyström features are the kernel's own: margins equal a plain kernel ridge regression's."""
    r = random.Random(15)
    texts = ["".join(r.choice("abcdefgh " if i % 2 else "efghijkl ") for _ in range(60)) for i in range(40)]
    langs = ["aa" if i % 2 else "bb" for i in range(40)]
    sets = [lang_id.ngrams(t) for t in texts]
    model = lang_id.fit(sets, langs, landmarks=1000)
    shared = lambda a, b: len(np.intersect1d(a, b)) / np.sqrt(len(a) * len(b))
    kernel = np.array([[shared(a, b) for b in sets] for a in sets])
    y = np.where(np.array(langs)[:, None] == np.array(["aa", "bb"]), 1.0, -1.0)
    alpha = np.linalg.solve(kernel + lang_id.RIDGE * len(sets) / 100 * np.eye(40), y)
    new = ["".join(r.choice("abcdefghijkl ") for _ in range(50)) for _ in range(20)]
    margins = np.array([[shared(lang_id.ngrams(t), s) for s in sets] for t in new]) @ alpha
    got, score = model.predict(new)
    assert got == [["aa", "bb"][k] for k in margins.argmax(1)]
    odds = np.exp(6 * (margins - margins.max(1, keepdims=True)))
    assert np.allclose(score, 1 / odds.sum(1), atol=1e-3)


def test_kernel_is_that_of_shared_ngrams():
    a, b = "Hello, world!", "yellow wool"

    def grams(t):
        c = lang_id.letter_classes()[[ord(x) for x in t]].tolist()
        return {tuple(c[i : i + n]) for n in (1, 2, 3) for i in range(len(c) - n + 1)} - {(0,)}

    assert len(lang_id.ngrams(a)) == len(grams(a))
    assert len(np.intersect1d(lang_id.ngrams(a), lang_id.ngrams(b))) == len(grams(a) & grams(b))


# exact dedup


def test_exact_duplicates(spark, docs, empty):
    long = [(100 + i, prose(9000, 5) + tail, None, None, None) for i, tail in enumerate(["", "", "x", "y", "y", "Y"])]
    df = docs.unionByName(spark.createDataFrame(long, DOCS))
    rows = df.collect()
    groups = collections.defaultdict(list)
    for r in rows:
        groups[lower(r.text)].append(r.doc_id)
    keep = {t: max((i for i in v if i is not None), default=None) for t, v in groups.items()}
    got = exact_dedup.exact_duplicates(df).collect()
    assert sorted(str((r.id, r.keep_id, r.group_size, r.text_sha256)) for r in got) == sorted(str((r.doc_id, keep[t := lower(r.text)], len(groups[t]), hashlib.sha256(t).hexdigest())) for r in rows)
    assert collections.Counter(r.text_sha256 for r in got if r.kept) == {hashlib.sha256(t).hexdigest(): 1 for t in groups}
    stay = exact_dedup.drop_exact_duplicates(df.withColumn("sha", F.lit(1)).withColumn("n", F.lit(2)))
    assert stay.columns == [*df.columns, "sha", "n"]
    assert sorted(str(r.doc_id) for r in stay.collect()) == sorted(str(v) for v in keep.values())
    clash = df.withColumn("row_number", F.lit(3)).withColumn("__block", F.lit(4)).withColumn("bits_of_rows", F.lit(5))
    shuffled = exact_dedup.drop_exact_duplicates(clash, most_blocks=0)
    assert shuffled.columns == clash.columns
    assert sorted(str(r.doc_id) for r in shuffled.collect()) == sorted(str(v) for v in keep.values())
    assert exact_dedup.exact_duplicates(empty).count() == 0 == exact_dedup.drop_exact_duplicates(empty).count()


def test_many_groups_of_copies_over_many_blocks(spark):
    """More groups than any table of theirs has room for in one task, one of a third of the rows, rows in several bitmaps."""
    n = 30_000
    df = spark.range(0, n, 1, 3).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "the hot text " * 40).otherwise(F.concat(F.lit("copy " * 30), F.floor(F.col("id") / 6))).alias("text"))
    stay = exact_dedup.drop_exact_duplicates(df)
    rows = df.toPandas()
    assert sorted(stay.toPandas().doc_id) == sorted(rows.groupby("text").doc_id.max())
    assert exact_dedup.drop_exact_duplicates(df, most_blocks=2).count() == rows.text.nunique()


# URL filters

PAGES = "page_id long, url string, html string"


def plain_judge(url):
    u = url or ""
    host = path = ""
    if "://" in u:
        rest = u.split("://", 1)[1]
        host = re.split(r"[/?#]", rest, maxsplit=1)[0]
        path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
        host = lower(host).decode()
    fit = [(len(h) + len(p), h + p, k) for k, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fit)[1:] if fit else (None, None))


def test_url_rules_and_list(spark):
    urls = [None, "", "no scheme", "://", "http://", "https://A.Example.ORG/es/x?y#z", "http://example.org/en/12", "http://x.example.org", "http://a.com/fr/", "http://com/de/q", "http://acom/de/", "ftp://a.net/x://y?z", "http://www.a.net/p/?utm_source=1&b=2", "https://a.net:443/p?b=2#f", "http://a.net/p?c=3", "http://a.net/q\n/r", "http://org/#"]
    pages = spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)] + [(1, "", None)], PAGES).withColumn("listed", F.lit("own"))
    out = url_filter.judge(pages, url_filter.repeated_urls(pages)).collect()
    assert len(out) == len(urls) + 1
    for r in out:
        host, path, rule, verdict = plain_judge(r.url)
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.listed == (r.page_id in (12, 13)) and r.verdict == (verdict or ("block" if r.listed else "allow"))
    none = spark.createDataFrame([], "url string")
    assert url_filter.judge(pages.where("false"), none).count() == 0
    assert {r.verdict for r in url_filter.judge(pages, none, rules=[]).collect()} == {"allow"}


def test_bloom_has_no_false_negative_and_few_false_positives(spark):
    keys = spark.range(2000).select(F.concat(F.lit("k"), "id").alias("key"))
    words, blocks = bloom.build(keys, "key")
    probes = spark.range(20000).select(F.concat(F.lit("k"), "id").alias("key"), "id")
    out = bloom.probe(probes, F.col("key"), words, blocks)
    assert out.where("id < 2000 and not __possible").count() == 0
    assert out.where("id >= 2000 and __possible").count() < 900


# mixing


@pytest.mark.parametrize("shares", [[1], [1, 1], [3, 1], [5, 3, 2], [97, 2, 1], [7, 7, 7, 1]])
def test_schedule_is_fair(shares):
    slots = mixing.schedule(shares)
    total = sum(shares)
    assert sorted(s for _, _, s in slots) == list(range(total))
    done = [0] * len(shares)
    for i, j, t in sorted(slots, key=lambda x: x[2]):
        assert j == done[i]
        done[i] += 1
        for k, a in enumerate(shares):
            assert abs(done[k] - a * (t + 1) / total) < 1


def test_mix_keeps_rows_and_shares(spark, empty):
    rows = [(i, f"t{i}", None, "a" if i < 700 else "b" if i < 1000 else None, None) for i in range(1100)] + [(0, "t0", None, "a", None)]
    df = spark.createDataFrame(rows, DOCS).withColumn("Seq", F.lit(1))
    out = mixing.mix(df, {"a": 2, None: 1}, default_share=3, block_rows=10).orderBy("mix_order").collect()
    assert len(out) == 1101 and len({r.mix_order for r in out}) == 1101
    seen, share = collections.Counter(), {"a": 2, "b": 3, None: 1}
    ends = {s: max(r.slot for r in out if r.source == s) for s in share}
    for slot in range(min(ends.values())):
        seen.update(r.source for r in out if r.slot == slot)
        for s, a in share.items():
            assert abs(seen[s] - 10 * a * (slot + 1) / 6) < 10
    laid = mixing.mixed_rows(df, {"a": 2})
    assert laid.columns == [c for c in df.columns if c != "Seq"] and laid.count() == 1101
    assert mixing.mix(empty, {"a": 1}).count() == 0 == mixing.mixed_rows(empty).count()


def test_mixture_splits_hot_buckets(spark, monkeypatch):
    """A third of the rows repeat one id, or have none: still each has a place, and each source's places have no gap."""
    monkeypatch.setattr(mixing, "HOT", 300)
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 100)
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, f"s{i % 4}" if i % 5 else None, i) for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, row_number int")
    out = mixing.mix(df, {"s0": 3, "s1": 2}, block_rows=4).toPandas()
    assert len(out) == 6000 and out.mix_order.is_unique and sorted(out.row_number) == list(range(6000))
    for _, g in out.groupby("source", dropna=False):
        assert sorted(g.seq) == list(range(len(g)))


# quality


def plain_counts(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    c = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    cover = {k for i in range(len(w) - 7) if c[tuple(w[i : i + 8])] > 1 for k in range(i, i + 8)}
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum((t or "").count(s) for s in "#*$%&|<>"), len(lines) - len(set(lines)), len(cover)


def test_quality_counts(spark):
    r = random.Random(9)
    texts = [*TEXTS, "a b c d e f g h " * 3, "a " * 9 + "\n" + "a " * 9, "<|x|> é # \n\n \nq\nq", "x " * 8]
    texts += [" ".join(r.choice("abc") for _ in range(r.randint(0, 80))) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").withColumn("n_words", F.lit("own"))
    got = quality.text_counts(df, keep=["id"]).collect()
    for x in got:
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == plain_counts(texts[x.id])


def test_binomial_bound(spark):
    from math import comb

    rows = [(k, n) for n in (1, 10, 300) for k in range(0, n // 20 + 2)]
    df = spark.createDataFrame(rows, "k long, n long")
    for x in df.select("k", "n", quality.binomial_cdf(F.col("k"), F.col("n"), 0.05).alias("c")).collect():
        exact = sum(comb(x.n, i) * 0.05**i * 0.95 ** (x.n - i) for i in range(x.k + 1))
        assert x.c == 1.0 if x.k >= x.n * 0.05 else abs(x.c / exact - 1) < 1e-9


def test_quality_cutoffs_hold_the_risk(spark, empty):
    r = random.Random(10)
    rows, labels = [], []
    for i in range(6000):
        good = i % 5 > 0
        t = prose(30, i)
        if not good:
            t = t.replace(" ", " ### ")
        elif r.random() < 0.001:
            t = t.replace(" ", " # ")
        rows.append((i, t, "en" if i < 5900 else None, None, None))
        labels.append((i, int(good), 0))
    docs, lab = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels + labels[:3], "doc_id long, quality int, toxic int")
    out = quality.judge(docs, lab)
    k = {x.id: x.kept for x in out.collect()}
    assert len(k) == 6000
    good_lost = sum(not k[i] for i, g, _ in labels if g and i < 5900)
    assert good_lost <= quality.RISK * 4720 and not any(k[i] for i, g, _ in labels if not g and i < 5900)
    assert all(k[i] for i in range(5900, 6000))  # too few labels in that stratum: nothing is certified
    assert quality.judge(empty, lab).count() == 0
    assert quality.judge(docs, lab.where("false")).where("not kept").count() == 0
