"""Each operator against a plain version of itself on small frames, with nulls, ties, repeats and empty tables."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from loadcast.llm import chat, common, imatch, langid, mixing, neighbours, overlap, packing, pii, simhash, toxicity, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = {
    "xa": "kamo tiru sena loka miro tanu".split(),
    "xb": "stry ghol brek wund plor sked".split(),
    "xc": "ouille aieau eveux oitre ionne uage".split(),
}


def prose(lang: str, n: int, seed: int) -> str:
    rng = random.Random(f"{lang} {n} {seed}")
    return " ".join(rng.choice(WORDS[lang]) + rng.choice(WORDS[lang]) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, prose(lang, 5 + i % 40, i), lang, f"s{i % 3}" if i % 5 else None, 1) for i, lang in enumerate(sorted(WORDS) * 30)]
    rows += [(900, None, "xa", "s1", 0), (901, "", "xa", "s1", 0), (902, " \n ", None, None, 3), (903, "12 34 !?", "xb", "s2", 8)]
    rows += [rows[3], rows[3], (None, prose("xa", 9, 1), "xa", "s0", 1), (904, prose("xb", 30_000, 7), "xb", "s2", 1)]
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


def empty(spark):
    return spark.createDataFrame([], DOCS)


# Language


def test_languages_and_mixtures(spark, docs):
    model = langid.train(docs.where("doc_id % 4 != 1"))
    extra = spark.createDataFrame([(5000, prose("xa", 60, 1) + " " + prose("xc", 40, 2))], "doc_id long, text string")
    found = {r.id: r for r in langid.identify(docs.select("doc_id", "text").unionByName(extra), model).collect()}
    for r in docs.where("doc_id < 90").collect():
        assert found[r.doc_id].lang_pred == r.lang
        assert 0 <= found[r.doc_id].score <= 1
    for i in (900, 901, 902, 903):
        assert (found[i].lang_pred, found[i].score) == ("und", 0.0)
    assert found[904].lang_pred == "xb"
    mixed = found[5000]
    assert [x.lang for x in mixed.languages] == ["xa", "xc"]
    assert mixed.score == pytest.approx(0.6, abs=0.05)


def test_mixture_likelihood_is_that_of_a_plain_search():
    rng = np.random.default_rng(1)
    ll = np.log(rng.uniform(0.05, 1, (60, 2))).astype(np.float32)
    shares, kept = langid.mixtures(ll, np.zeros(60, dtype=int), 2, iterations=300)
    grid = np.linspace(0.001, 0.999, 999)
    like = np.log(np.exp(ll[:, :1]) * grid + np.exp(ll[:, 1:]) * (1 - grid)).sum(axis=0)
    penalised = like.max() - 0.5 * np.log(60)
    if penalised > ll.sum(axis=0).max():
        assert kept[0] == 2 and shares[0, 0] == pytest.approx(grid[like.argmax()], abs=0.01)
    else:
        assert kept[0] == 1 and shares[0].max() == 1.0
    assert kept[1] == 0


def test_language_without_rows_or_labels(spark, docs):
    assert langid.train(empty(spark)) is None
    assert langid.identify(empty(spark), None).count() == 0
    assert {r.lang_pred for r in langid.identify(docs, None).collect()} == {"und"}
    assert langid.keep_known(docs, None).count() == 0
    kept = langid.keep_known(docs.withColumn("id", F.lit(1)), langid.train(docs))
    assert kept.columns == [*docs.columns, "id"]
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in docs.collect()} - {900, 901, 902, 903}


# Near duplicates


def plain_fingerprint(text, k=3):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, prints, radius):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(ids)):
        groups.setdefault(find(i), []).append(ids[i])
    return {find(i): min((x for x in groups[find(i)] if x is not None), default=None) for i in range(len(ids))}, find


def test_components_equal_all_pairs(spark, docs):
    near = [(1000 + i, prose("xa", 400, 1) + f" end{i % 7}", "xa", "s", 1) for i in range(40)]
    both = docs.unionByName(spark.createDataFrame(near, DOCS))
    rows = both.select("doc_id", "text").collect()
    prints = [plain_fingerprint(r.text) for r in rows]
    least, find = plain_components([r.doc_id for r in rows], prints, 2)
    expected = Counter((r.doc_id, f"{p:016x}", least[find(i)]) for i, (r, p) in enumerate(zip(rows, prints)))
    found = simhash.near_duplicates(both.withColumn("fp", F.lit("clash")))
    got = Counter((r.id, f"{r.fp % 2**64:016x}", r.component_id) for r in found.collect())
    assert got == expected
    kept = simhash.deduplicate(both)
    assert kept.columns == both.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(dict.fromkeys({c for _, _, c in expected}, 1))
    assert simhash.near_duplicates(empty(spark)).count() == 0
    assert simhash.deduplicate(empty(spark)).count() == 0


def test_planes_find_what_all_pairs_find(spark):
    rng = random.Random(3)
    centres = [rng.getrandbits(64) for _ in range(30)] + [0]
    flipped = {c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))) for c in centres for _ in range(60)}
    values = sorted(flipped | {1, 3, 7, 15})
    signed = np.array(values, dtype=np.uint64).view(np.int64).tolist()
    for radius in (0, 1, 2):
        links = simhash.near_links(spark.createDataFrame([(v,) for v in signed], "fp long"), radius).collect()
        for r in links:
            assert 0 < ((r.a ^ r.b) % 2**64).bit_count() <= radius
        least, find = plain_components(values, values, radius)
        mine = common.components(spark.createDataFrame(links or [(1, 1)], "a long, b long"), "a", "b").collect()
        root = {r.node % 2**64: r.root % 2**64 for r in mine}
        groups = {}
        for i, v in enumerate(values):
            groups.setdefault(find(i), set()).add(root.get(v, v))
        assert all(len(g) == 1 for g in groups.values())
        assert len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_large_buckets_are_split(spark, monkeypatch):
    monkeypatch.setattr(simhash, "PART_ROWS", 16)
    monkeypatch.setattr(simhash, "BLOCK_ROWS", 20)
    values = [(1 << a) | (1 << b) for a in range(20) for b in range(20)]
    prints = spark.createDataFrame([(v,) for v in sorted(set(values))], "fp long")
    found = common.components(simhash.near_links(prints, 2), "a", "b")
    assert found.select("root").distinct().count() == 1
    assert found.count() == len(set(values)) - 1


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(100)] + [(500, i) for i in range(501, 560)] + [(7, 7)]
    found = {r.node: r.root for r in common.components(spark.createDataFrame(chain, "a long, b long"), "a", "b").collect()}
    assert found == {i: 0 for i in range(1, 101)} | {i: 500 for i in range(501, 560)}
    assert common.components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_stage_joins_texts_with_most_shingles_in_common(spark, docs, monkeypatch):
    rng = random.Random(8)
    rows = []
    for i in range(40):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(40, 400))]
        for j in range(4):
            edited = [w if rng.random() > 0.015 * j else f"e{rng.randrange(5000)}" for w in words]
            rows.append((3000 + 4 * i + j, "  ".join(edited).upper() if j == 3 else " ".join(edited), "xa", "s", 1))
    both = docs.unionByName(spark.createDataFrame(rows, DOCS)).repartition(5)
    texts = [(r.doc_id, r.text) for r in both.select("doc_id", "text").collect()]

    def plain(text):
        w = (text or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    sets = [plain(t) for _, t in texts]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    root = list(range(len(sets)))
    for i, j in links * 6:
        root[i] = root[j] = min(root[i], root[j])
    least = {}
    for r, (d, _) in zip(root, texts):
        least[r] = min(least.get(r, 10**9), 10**9 if d is None else d)
    expected = sorted(least.values())
    for part in (overlap.PART_ROWS, 2):
        monkeypatch.setattr(overlap, "PART_ROWS", part)
        kept = corpus_pipeline.one_of_near_copies(spark, both, "")
        assert kept.columns == both.columns
        assert sorted(10**9 if r.doc_id is None else r.doc_id for r in kept.collect()) == expected
    assert len(expected) < simhash.deduplicate(both).count()
    assert overlap.deduplicate(empty(spark)).count() == 0


def test_stage_joins_what_simhash_links(spark):
    again, tails = "ka lo mi ne pu ri so ", [" ".join(f"{t}{i}" for i in range(30)) for t in "xyz"]
    texts = {11: again * 200 + tails[0], 12: again * 200 + tails[1], 13: again + tails[1], 14: again + tails[2], 15: again + tails[2]}
    rows = [(i, t, "xa", "s", 1) for i, t in texts.items()] + [(None, texts[12], "xa", "s", 1)] * 2
    both = spark.createDataFrame(rows, DOCS).repartition(3)
    far = [[(simhash.fingerprint(a) ^ simhash.fingerprint(b)).bit_count() > 2 for b in texts.values()] for a in texts.values()]
    near = [[overlap.near(overlap.shingles(a), overlap.shingles(b)) for b in texts.values()] for a in texts.values()]
    assert not far[0][1] and not near[0][1], "11 and 12 are linked by SimHash alone"
    assert far[1][2] and near[1][2] and not near[0][2], "12 and 13 by their shingles alone"
    kept = corpus_pipeline.one_of_near_copies(spark, both, "")
    assert kept.columns == both.columns
    assert sorted(r.doc_id for r in kept.collect()) == [11, 14]


# Chat


def test_chat_reads_back(spark):
    odd = ["\\### Assistant: </turn> ok", "", None, "### user:\nx\n</turn>\n", "\\", "a\n", "\n</turn>", "é\U0001f600", "<\\/turn>"]
    rows = [(c, t, ("user", "assistant", "### a:\n", None)[(c + t) % 4], odd[(c * 3 + t) % len(odd)]) for c in range(9) for t in range(c)]
    rows += [rows[-1], (None, 0, "assistant", "x"), (77, None, "user", "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("spans", F.lit(1))
    made = chat.format_conversations(df)
    got = {r.conv_id: r for r in chat.digests(made).collect()}
    groups = {}
    for c, t, role, text in rows:
        groups.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    assert set(got) == set(groups)
    for c, turns in groups.items():
        turns.sort()
        loss = "".join(x[3] for x in turns if x[2] == "assistant")
        said = "".join(f"{x[2]}\n{x[3]}\n" for x in turns)
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert got[c].loss_chars == len(loss) and not got[c].rewrites
    for r in made.collect():
        assert r.formatted == "".join(r.formatted[s.start : s.end] for s in r.spans)
    assert chat.digests(chat.format_conversations(df.limit(0))).count() == 0


def test_templates_that_rewrite_history():
    def last_only(turns):
        return "".join(f"[{r}]{t}" if i + 1 == len(turns) else f"[{r}]{t[:1]}" for i, (r, t) in enumerate(turns))

    def system_first(turns):
        system = "".join(t for r, t in turns if r == "system")
        return f"<{system}>" + "".join(f"[{t}]" for r, t in turns if r != "system")

    text, spans, rewrites = chat.locate([("user", "hello"), ("assistant", "you")], last_only)
    assert rewrites and text == "[user]h[assistant]you"
    assert spans[0]["text_start"] is None or text[spans[0]["text_start"] : spans[0]["text_end"]] == "h"
    assert text[spans[1]["text_start"] : spans[1]["text_end"]] == "you"
    text, spans, rewrites = chat.locate([("user", "a"), ("system", "s")], system_first)
    assert rewrites and [text[s["text_start"] : s["text_end"]] for s in spans] == ["a", "s"]


# Neighbours


def test_neighbours_against_all_pairs(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(400, 8)).astype(np.float32)
    base[300:360] = base[0]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(base)]
    rows += [(1000, None, 0), (1001, [0.0] * 8, 0), (1002, [float("nan")] * 8, 0), (1003, [1.0, None] + [0.0] * 6, 0), (1004, [1.0], 0), (None, [1.0] * 8, 0), rows[5]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("score", F.lit("x"))
    got = neighbours.nearest(df, F.col("vec_id") % 50 == 0, k=5)
    x = base.astype(float)
    cos = (x @ x.T) / np.outer(np.linalg.norm(x, axis=1), np.linalg.norm(x, axis=1))
    by = {}
    for r in got.orderBy("query_id", "rank").collect():
        by.setdefault(r.query_id, []).append(r)
    assert set(by) == {i for i in range(400) if i % 50 == 0}
    hits = 0
    for q, found in by.items():
        order = [i for i in np.lexsort((np.arange(400), -np.round(cos[q], 9))) if i != q][:5]
        assert [r["rank"] for r in found] == [1, 2, 3, 4, 5]
        hits += len(set(order) & {r.vec_id for r in found})
        for r in found:
            assert r.score == pytest.approx(cos[q, r.vec_id], abs=1e-12)
    assert hits >= 0.95 * 5 * len(by)
    assert [r.vec_id for r in by[300]] == [0, 301, 302, 303, 304]
    few = neighbours.nearest(df.where("vec_id < 3"), F.col("vec_id") == 0)
    assert [r.vec_id for r in few.orderBy("rank").collect()] == [i for i in np.argsort(-cos[0, :3]) if i]
    assert neighbours.nearest(df.limit(0), F.lit(True)).count() == 0


def test_cosines_of_very_large_and_small_vectors(spark):
    base = np.random.default_rng(8).normal(size=(120, 6))
    sizes = [(1.0, 1e200, 1e-200, 1.7e308 / np.abs(base).max(), 2.0**-1000)[i % 5] for i in range(120)]
    df = spark.createDataFrame([(i, (v * c).tolist()) for i, (v, c) in enumerate(zip(base, sizes))], "vec_id long, embedding array<double>")
    size = np.linalg.norm(base, axis=1)
    cos = (base @ base.T) / np.outer(size, size)
    found = neighbours.nearest(df, F.col("vec_id") % 10 == 0).collect()
    assert len(found) == 12 * 5
    for r in found:
        order = [i for i in np.argsort(-cos[r.query_id]) if i != r.query_id]
        assert r.vec_id == order[r["rank"] - 1] and r.score == pytest.approx(cos[r.query_id, r.vec_id], abs=1e-12)
    plain = base[:50].astype(np.float32).astype(float)
    even = neighbours._even(plain)
    norms = [np.linalg.norm(x, axis=1) for x in (plain, even)]
    assert ((plain[:25] * plain[25:]).sum(axis=1) / (norms[0][:25] * norms[0][25:]) == (even[:25] * even[25:]).sum(axis=1) / (norms[1][:25] * norms[1][25:])).all()


def test_visits_grow_until_recall_is_reached(spark):
    base = np.random.default_rng(6).normal(size=(6000, 32)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(base)], "vec_id long, embedding array<float>").repartition(4)
    found = {}
    for r in neighbours.nearest(df, F.col("vec_id") % 60 == 0, k=5, visits=4).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    u = neighbours._unit(base.astype(float))
    hits = sum(len(found[q] & set(np.argsort(-np.where(np.arange(6000) == q, -2, u @ u[q]))[:5].tolist())) for q in range(0, 6000, 60))
    assert hits >= 0.9 * 500


def test_cells_of_rows_are_those_searched_first():
    x = neighbours._unit(np.random.default_rng(0).normal(size=(3000, 6)))
    forest = neighbours.fit(x[:500], 30_000, trees=3, leaf=16, cell=8)
    assert forest.extra > 0
    cells = forest.cells(x)
    every = sum(len(c) for c in forest.centres) << forest.extra
    for i in range(5):
        found = forest.search(x[i], every)
        assert set(found[:3]) == {(t, int(cells[i, t])) for t in range(3)}
        assert len(set(found)) == len(found) == every


# Toxicity


def test_toxic_units(spark):
    rng = random.Random(1)
    bad = ["gromblax", "vizzock", "snarfle"]
    rows, labels = [], []
    for i in range(400):
        words = prose("xa" if i % 2 else "xc", 20, i).split()
        toxic = i % 4 == 0
        if toxic:
            words[rng.randrange(20)] = bad[i // 4 % 3]
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([*labels, (5, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, marks.where("doc_id % 5 != 0"))
    odd = [(1000, None), (1001, ""), (1002, prose("xa", 500, 3) + " grom-blax " + prose("xc", 500, 3)), (1003, prose("xa", 30, 9) + " v i z z o c k"), (1004, "snaarfle you")]
    found = {r.id: r for r in toxicity.score(docs.unionByName(spark.createDataFrame(odd, docs.schema)), model).collect()}
    wrong = [(i, t, found[i].score, rows[i][1]) for i, t in labels if i % 5 == 0 and found[i].predicted != t]
    assert not wrong
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found.values())
    assert not found[1000].predicted and not found[1001].predicted
    assert found[1002].predicted and found[1003].predicted and found[1004].predicted
    assert toxicity.train(docs, marks.limit(0)) is None
    assert {r.score for r in toxicity.score(docs, None).collect()} == {0.0}
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_kernel_expansion_is_that_of_pairs():
    words = ["gromblax", "gro.mblax", "gxrxoxm", "vizzock", "plain"]
    features, columns = toxicity._features(words)
    weights = np.zeros(toxicity.SYMBOLS**3)
    weights[columns >= 0] = features[0][columns[columns >= 0]]
    for word, row in zip(words, features):
        alone = toxicity.document_scores([word], weights, 0.0)[0]
        assert alone == pytest.approx(float(features[0] @ row), abs=1e-9)
    assert features[0] @ features[1] > features[0] @ features[3]


# Revisits


def test_revisits_across_tasks(spark):
    rng = random.Random(4)
    rows = []
    for i in range(600):
        url = rng.choice(["http://www.A.org/x/?b=2&a=1#f", "https://a.org/x?a=1&b=2&utm_source=z", "https://b.org:443"]) if i % 9 else None
        kind = "response" if i % 5 < 2 else "revisit"
        tag = rng.choice(["1", 'W/"2"', '"2"'])
        headers = {"etag": tag, "content-length": "7", "x": str(i)} if i % 7 else None
        rows.append((i, url, rng.randrange(200) if i % 31 else None, kind, headers, f"p{i}" if kind == "response" else None, "extra"))
    df = spark.createDataFrame(rows, "record_id long, url string, time long, kind string, headers map<string,string>, payload string, state string")
    got = {r.record_id: r for r in warc.resolve_revisits(df.repartition(4)).collect()}
    assert len(got) == sum(r[3] == "revisit" for r in rows)
    site = {"http://www.A.org/x/?b=2&a=1#f": "a.org/x?a=1&b=2", "https://a.org/x?a=1&b=2&utm_source=z": "a.org/x?a=1&b=2", "https://b.org:443": "b.org", None: None}
    for i, url, time, kind, headers, _, _ in rows:
        if kind == "response":
            continue
        r = got[i]
        assert r.url_key == site[url]
        before = [x for x in rows if x[3] == "response" and x[1] and url and site[x[1]] == site[url] and time is not None and x[2] is not None and x[2] < time]
        if not before:
            assert (r.state, r.response_id, r.payload) == ("no_response", None, None)
            continue
        best = max(before, key=lambda x: (x[2], x[0]))
        assert r.response_id == best[0]
        if not headers or not best[4]:
            assert r.state == "no_validator" and r.payload is None
        elif headers["etag"].removeprefix("W/") != best[4]["etag"].removeprefix("W/"):
            assert r.state == "changed" and r.headers == headers
        else:
            assert r.state == "resolved" and r.payload == best[5]
            assert r.headers == {**best[4], **{k: v for k, v in headers.items() if k != "content-length"}}
    assert warc.resolve_revisits(df.limit(0)).count() == 0


# Personal data


def luhn(digits):
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(digits)))) % 10


def test_pseudonyms_keep_format_and_links(spark):
    card = lambda n: next(f"{n}{c}" for c in range(10) if luhn(f"{n}{c}") == 0)
    cards = [card(400000000000000 + 7919 * i) for i in range(60)]
    found = {
        "card": cards,
        "ip": [f"{i}.{i * 3 % 256}.7.{255 - i}" for i in range(60)],
        "ssn": [f"{i + 640:03d}-{i % 98 + 1:02d}-{i + 1:04d}" for i in range(60) if i + 640 != 666],
        "date": [f"{1950 + i}-0{i % 9 + 1}-1{i % 10}" for i in range(60)],
        "phone": [f"+1 (2{i:02d}) 555-{i * 7:04d}" for i in range(60)],
        "mail": [f"ab{chr(97 + i % 26)}.{i:02d}@mail.example.com" for i in range(60)],
    }
    form = {
        "card": r"\d{16}", "ip": r"(\d{1,3}\.){3}\d{1,3}", "ssn": r"\d{3}-\d{2}-\d{4}", "date": r"\d{4}-\d\d-\d\d",
        "phone": r"\+1 \([2-9]\d\d\) [2-9]\d\d-\d{4}", "mail": r"[a-z]{3}\.\d\d@mail\.example\.com",
    }
    rows = [(k, v, f"see {v}, and {v}.") for k, vs in found.items() for v in vs]
    df = spark.createDataFrame(rows, "kind string, value string, text string")
    out = pii.pseudonymise(df, "k", found_col="n").collect()
    seen = {}
    for r in out:
        m = re.fullmatch(rf"see ({form[r.kind]}), and \1\.", r.text)
        assert m and m[1] != r.value and r.n == 2, r
        seen.setdefault(r.kind, set()).add(m[1])
    assert {k: len(v) for k, v in seen.items()} == {k: len(set(v)) for k, v in found.items()}
    assert all(luhn(c) == 0 for c in seen["card"])
    assert all(max(map(int, x.split("."))) < 256 for x in seen["ip"])
    other = {r.text for r in pii.pseudonymise(df, "other").collect()}
    assert not other & {r.text for r in out}


def test_marked_phone_numbers_may_have_any_digits(spark):
    forms = ["+1 ({}) {}-{}", "({}) {}-{}", "+1-{}-{}-{}", "1-{}-{}-{}"]
    rows = [(i, f.format(f"{a:03d}", f"{a * 7 % 1000:03d}", f"{a * 13 % 10000:04d}")) for a in range(0, 1000, 3) for i, f in enumerate(forms)]
    df = spark.createDataFrame([(i, v, f"call {v}, now") for i, v in rows], "form int, value string, text string")
    out = pii.pseudonymise(df, "k", found_col="n").collect()
    assert {r.n for r in out} == {1}
    assert all(re.sub(r"\d", "0", r.text) == re.sub(r"\d", "0", f"call {r.value}, now") for r in out)
    assert len({r.text for r in out}) == len(rows)
    numbers = {}
    for r in out:
        numbers.setdefault(re.sub(r"\D", "", r.value)[-10:], set()).add(re.sub(r"\D", "", r.text)[-10:])
    assert all(len(x) == 1 for x in numbers.values())
    assert sum(a in b for a, b in numbers.items()) < 3


def test_dates_and_short_formats_are_permutations(spark):
    days = spark.range(0, 3000).select(F.date_format(F.date_add(F.lit("2020-01-01"), F.col("id").cast("int")), "dd.MM.yyyy").alias("text"))
    out = pii.pseudonymise(days, "k").collect()
    assert len({r.text for r in out}) == 3000
    assert all(re.fullmatch(r"\d\d\.\d\d\.\d{4}", r.text) for r in out)


def test_month_first_dates_are_permuted_among_themselves(spark):
    late = spark.range(0, 146097).select(F.date_add(F.lit("1900-01-01"), F.col("id").cast("int")).alias("d")).where("day(d) > 12")
    rows = late.select(F.date_format("d", "MM/dd/yyyy").alias("text"))
    out = pii.pseudonymise(rows, "k").where(F.col("text").rlike(r"^(0\d|1[0-2])/(1[3-9]|2\d|3[01])/\d{4}$"))
    assert out.where(F.try_to_date("text", "MM/dd/yyyy").isNotNull()).distinct().count() == 88497
    early = spark.createDataFrame([("12/31/2024",), ("31/12/2024",), ("13/13/2024",)], "text string")
    assert [a.text == b for a, b in zip(pii.pseudonymise(early, "k").collect(), ("12/31/2024", "31/12/2024", "13/13/2024"))] == [False, False, True]


def test_values_beside_other_numbers(spark):
    card, amex = "4845168114407329", "378282246310005"
    assert luhn(card) == luhn(amex) == 0
    spaced = " ".join(card[i : i + 4] for i in range(0, 16, 4))
    grouped = f"{amex[:4]} {amex[4:10]} {amex[10:]}"
    values = ["212-555-1234", "+1 (017) 555-7713", card, spaced, spaced.replace(" ", "-"), grouped, "1987-02-14", "123-45-6789"]
    beside = ["{}", "{} 100 times", "{} 12 items", "{} 100", "no 12 {}", "10 20 30 40 {}", "7 {} 8 9", "1234 {}", "{} 212-555-9876", "212 555 1234 {}", "1987-02-14 {} 5"]
    rows = [(i, v, b, b.format(v)) for i, v in enumerate(values) for b in beside]
    out = pii.pseudonymise(spark.createDataFrame(rows, "i int, value string, beside string, text string"), "k").collect()
    alone = {r.i: r.text for r in out if r.beside == "{}"}
    plain = {b: b for b in beside}
    for b in ("212 555 1234 {}", "{} 212-555-9876", "1987-02-14 {} 5"):
        plain[b] = pii.pseudonymise(spark.createDataFrame([(b.replace("{}", "x"),)], "text string"), "k").first().text.replace("x", "{}")
        assert plain[b] != b
    wrong = [(r.value, r.beside, r.text) for r in out if r.text != plain[r.beside].format(alone[r.i])]
    assert all(alone[i] != v for i, v in enumerate(values)) and not wrong, wrong
    long = spark.createDataFrame([("1234 " * 9000,), ("12 " * 9000,), ("1234567890123 " * 900,)], "text string")
    assert pii.pseudonymise(long, "k").count() == 3


def test_what_is_not_valid_stays(spark):
    kept = ["4111 1111 1111 1112", "300.1.1.1", "000-12-3456", "666-12-3456", "1987-02-30", "version 2.0.1", "x@y", "call 12345", "", None, " ", "1234567890123"]
    df = spark.createDataFrame([(t, 7) for t in kept], "text string, n int")
    out = pii.pseudonymise(df, "k", found_col="n").collect()
    assert [r.text for r in out] == kept and {r.n for r in out} == {0}
    assert pii.pseudonymise(df.limit(0), "k").count() == 0


# Packing


def test_encoder_is_the_tokenizer(docs):
    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    encode = packing.encoder(path, public_tokenizers.PATTERN)
    odd = ["", " ", "a  b", "a \n b", " a", "a ", "\n", "a\n\nb c", "<|endoftext|> x", "x <|endoftext|> y", "a<|endoftext|><|endoftext|>", " <|endoftext|> ", "<|endoftext| >", "x's 's t", "a\x1c b", "\u3000a b", "日本 語 x", "1 23  4"]
    for text in [*odd, *(r.text for r in docs.where("doc_id < 60").collect())]:
        assert np.frombuffer(encode(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids


def test_packing_is_whole_and_tight(spark, docs):
    path = public_tokenizers.path("byte_bpe_50k.json")
    pieces = packing.pieces(docs, path, public_tokenizers.PATTERN, keep_ids=True)
    packed = packing.pack(pieces.withColumn("offset", F.lit("clash"))).toPandas()
    by_doc = packed.groupby("doc_id", dropna=False).length.sum()
    assert by_doc[900] == by_doc[901] == 1
    assert packed[packed.doc_id == 904].sort_values("piece").length.tolist()[1:] == [2048] * (len(packed[packed.doc_id == 904]) - 1)
    for _, g in packed.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == (g.length.cumsum() - g.length).tolist() and g.length.sum() <= 2048
    assert packed.sequence_id.nunique() <= -(-packed.length.sum() // 2048) + 1
    assert len(packed) == pieces.count()
    again = packing.pack(packing.pieces(docs, path, public_tokenizers.PATTERN, keep_ids=True))
    joined = {r.sequence_id: r.ids for r in packing.sequences(again).collect()}
    for i, g in again.toPandas().sort_values("offset").groupby("sequence_id"):
        assert joined[i] == [x for ids in g.ids for x in ids]
    assert packing.pack(packing.pieces(docs.limit(0), path, public_tokenizers.PATTERN)).count() == 0


def test_genetic_algorithm_betters_best_fit():
    rng = np.random.default_rng(0)
    lengths = rng.integers(300, 900, 300)
    order = np.argsort(-lengths, kind="stable")
    plain = packing._best_fit(np.full(300, -1), np.zeros(0, dtype=np.int64), order, lengths, 2048)
    best = packing.evolve(lengths, 2048, random.Random(1), [])[0]
    assert np.bincount(best, weights=lengths).max() <= 2048
    assert best.max() <= plain.max()
    child = packing._cross(plain, best, lengths, 2048, random.Random(2))
    assert (child >= 0).all() and np.bincount(child, weights=lengths).max() <= 2048


def fewest_bins(lengths, size):
    """The exact optimum, by trying every bin for each item."""
    best = [len(lengths)]

    def put(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(bins)
            return
        for room in {b: None for b in bins}:
            if room >= lengths[i]:
                at = bins.index(room)
                put(i + 1, [*bins[:at], room - lengths[i], *bins[at + 1 :]])
        put(i + 1, [*bins, size - lengths[i]])

    put(0, [])
    return best[0]


def test_genetic_algorithm_lies_between_the_optimum_and_best_fit():
    for seed in range(60):
        rng = np.random.default_rng(seed)
        lengths = np.sort(rng.integers(15, 60, 10))[::-1].copy()
        plain = packing._best_fit(np.full(10, -1), np.zeros(0, dtype=np.int64), np.arange(10), lengths, 100).max() + 1
        best = packing.evolve(lengths, 100, random.Random(seed), [])[0]
        assert np.bincount(best, weights=lengths).max() <= 100
        assert fewest_bins(lengths.tolist(), 100) <= best.max() + 1 <= plain


def test_genetic_algorithm_wins_where_best_fit_does_not():
    """Items cut from full bins: best fit in falling order needs more bins than there were, crossover fewer than that."""
    won = 0
    for seed in range(8):
        rng = np.random.default_rng(seed)
        lengths = []
        for _ in range(60):
            a = int(rng.integers(300, 480))
            b = int(rng.integers(200, (1000 - a) // 2 + 1))
            lengths += [a, b, 1000 - a - b]
        lengths = np.array(lengths)
        order = np.argsort(-lengths, kind="stable")
        plain = packing._best_fit(np.full(180, -1), np.zeros(0, dtype=np.int64), order, lengths, 1000).max() + 1
        best = packing.evolve(lengths, 1000, random.Random(seed), [])[0].max() + 1
        assert 60 <= best <= plain
        won += best < plain
    assert won >= 3


# Mixing


def plain_targets(sizes, most=3.0, weights=(1, 2, 3)):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in full]
        rest = total - sum(most * sizes[s] for s in full)
        level = rest / sum(w[s] for s in free) if free else 0
        over = {s for s in free if w[s] * level > most * sizes[s]}
        if not over:
            return {s: most * sizes[s] if s in full else w[s] * level for s in names}
        full |= over


def test_targets_and_copies(spark, docs):
    many = spark.range(3000).select(
        F.col("id").alias("doc_id"), F.repeat(F.lit("w "), F.pmod("id", F.lit(9)).cast("int") + 1).alias("text"), F.lit("en").alias("lang"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 7)).alias("source"), F.lit(1).cast("long").alias("n_chars"),
    )
    tiny = spark.createDataFrame([(9000, "a b c", "en", "tiny", 1), (9001, None, "en", "void", 1), (9002, "x y", "en", None, 1)], DOCS)
    rows = many.unionByName(tiny).withColumn("size", F.lit("clash"))
    out = mixing.curriculum(rows).toPandas()
    assert len(out) == 3003 and list(out.columns).count("size") == 1
    sizes = out.groupby("source", dropna=False)["size"].sum()
    sizes = {(None if s != s or s is None else s): int(v) for s, v in sizes.items()}
    expected = plain_targets(sizes)
    for _, r in out.iterrows():
        s = None if r.source is None or r.source != r.source else r.source
        assert r.source_size == sizes[s] and r.target == pytest.approx(expected[s])
        assert 0 <= r.copies <= 3 and len(r.positions) == r.copies
        assert all(0 <= p <= 1 for p in r.positions)
    out["taken"] = out.copies * out["size"]
    for s, taken in out.groupby("source").taken.sum().items():
        assert abs(taken - expected[s]) <= 10
    again = mixing.curriculum(rows.repartition(7)).toPandas().sort_values("doc_id")
    assert again.copies.tolist() == out.sort_values("doc_id").copies.tolist()
    order = mixing.in_order(mixing.curriculum(rows)).select("position").collect()
    assert [r.position for r in order] == sorted(r.position for r in order)
    assert len(order) == out.copies.sum()
    assert mixing.curriculum(empty(spark)).count() == 0
    assert mixing.curriculum(docs).count() == docs.count()


@pytest.mark.parametrize("most_bytes", [mixing.SOURCE_BYTES, 0])
def test_sums_looked_up_either_way(spark, docs, monkeypatch, most_bytes):
    """Lines of sources as broadcast arrays and cells in a shuffle give the places of a plain line of words; no name clashes."""
    monkeypatch.setattr(mixing, "SOURCE_BYTES", most_bytes)
    helpers = ["_source", "_cell", "_share", "_start", "_words", "_rounds", "_class", "_middle", "_order", "_id", "_starts", "c0", "a.b"]
    rows = docs.select("doc_id", "text", "source", *[F.lit(i).alias(c) for i, c in enumerate(helpers)])
    out = mixing.curriculum(rows)
    assert out.columns == [*rows.columns, *mixing.OWN]
    assert out.select(*[F.col(f"`{c}`") for c in helpers]).distinct().collect() == [tuple(range(len(helpers)))]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert ("ReusedExchange" in plan or "hashpartitioning" in plan) == (most_bytes == 0)
    monkeypatch.undo()
    near = [F.round("target", 6), F.transform("positions", lambda x: F.round(x, 9)).cast("string")]
    want = mixing.curriculum(docs.select("doc_id", "text", "source")).select("doc_id", "copies", *near)
    assert out.select("doc_id", "copies", *near).exceptAll(want).collect() == []
    assert mixing.in_order(out).count() == out.agg(F.sum("copies")).first()[0]


def test_schedule_is_followed(spark):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("w w").alias("text"), F.element_at(F.array(*map(F.lit, "abc")), (F.col("id") % 3 + 1).cast("int")).alias("source"))
    out = mixing.in_order(mixing.curriculum(rows)).toPandas()
    for source, knots in zip("abc", mixing.SCHEDULES):
        at = out[out.source == source].position
        total = sum((a[1] + b[1]) / 2 * (b[0] - a[0]) for a, b in zip(knots, knots[1:]))
        first = np.interp(0.25, *zip(*knots))
        due = (knots[0][1] + first) / 2 * 0.25 / total
        assert (at < 0.25).mean() == pytest.approx(due, abs=0.02)


# Fingerprints


def test_imatch_against_plain(spark, docs):
    known = imatch.lexicon(docs)
    rows = docs.select("doc_id", "text").collect()
    df = Counter(t for r in rows for t in set(re.findall(r"\w+", (r.text or "").lower())))
    assert set(known.place) == {t for t, n in df.items() if imatch.LEAST * len(rows) <= n <= imatch.MOST * len(rows)}
    order = sorted(rows, key=lambda r: (-(r.doc_id if r.doc_id is not None else -(1 << 63)), r.text or ""))
    got = Counter()
    for r in imatch.edited_pairs(docs, known).collect():
        got[(r.id, r.n_chars, r.edited_sha256)] += 1
        assert 0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1
    expected = Counter()
    for r, after in zip(order, order[1:] + order[:1]):
        text, follow = r.text or "", after.text or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + follow[:half]
        expected[(r.doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest())] += 1
    assert got == expected
    prints = {}
    for r in imatch.fingerprints(docs, known).collect():
        prints.setdefault(r.fingerprint, []).append(r.id)
    texts = {}
    for r in rows:
        texts.setdefault(r.text or "", []).append(r.doc_id)
    assert len(prints) >= len(texts) - 2
    for group in texts.values():
        assert any(set(group) <= set(p) for p in prints.values())


def test_imatch_buckets(spark, monkeypatch):
    monkeypatch.setattr(imatch, "DOCS_PER_BUCKET", 7)
    rows = [(i * 3 % 101, prose("xa", 12, i)) for i in range(101)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = imatch.lexicon(docs)
    text = dict(rows)
    for r in imatch.edited_pairs(docs.withColumn("key", F.lit(1)), known).collect():
        follow = text[(r.id - 1) % 101]
        half = len(text[r.id]) // 2
        edited = text[r.id][: len(text[r.id]) - half] + follow[:half]
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.near_next == imatch.likeness(imatch.fingerprint(text[r.id], known), imatch.fingerprint(follow, known))
    one = imatch.edited_pairs(docs.limit(1), known).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert imatch.edited_pairs(docs.limit(0), imatch.lexicon(docs.limit(0))).count() == 0


# Shared helpers


def test_ranks(spark):
    df = spark.createDataFrame([(x,) for x in ["b", None, "ä", "a", "c"]], "s string")
    got = common.ranked(df.repartition(3), [F.col("s").asc_nulls_last()], "n").orderBy("n").collect()
    assert [(r.s, r.n) for r in got] == [("a", 0), ("b", 1), ("c", 2), ("ä", 3), (None, 4)]
