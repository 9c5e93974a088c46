"""Nulls, empty and long texts, ties, repeated rows, empty tables, and extra columns with clashing names."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm_queries import brute_components, brute_fingerprint

from pagetone.llm import decontaminate, graph, html_text, license_scan, mixing, quality, sharding, simhash, token_files, topk, toxicity

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, row bigint, `order` int, score double, words int"


def docs_of(spark, rows):
    """Documents with extra columns named like the operators' own."""
    return spark.createDataFrame([(i, t, "en", s, None, "k", 1, 2, 3.0, 4) for i, t, s in rows], DOCS)


LONG = " ".join(f"word{i % 977} filler{i % 131}" for i in range(30_000))
ROWS = [(1, None, "a"), (2, "", "a"), (3, "  \n ", None), (4, "One", "b"), (5, LONG, "b"), (5, LONG, "b"), (None, "No id here", None),
        (7, "Released under the MIT License. Mit\nlicense!", "a"), (8, "naïve café ÉTÉ", "a"), (9, "x" * 5000, "c")]


@pytest.fixture(scope="module")
def rows(spark):
    return docs_of(spark, ROWS)


@pytest.fixture(scope="module")
def none(spark):
    return docs_of(spark, [])


def test_license(rows, none):
    got = {(r["doc_id"], r["n_words"]): r for r in license_scan.license_scan(rows).collect()}
    assert len(license_scan.license_scan(rows).collect()) == len(ROWS)
    assert got[1, 0]["labels"] == "" and got[1, 0]["first_word"] is None and got[1, 0]["score"] == 0
    hit = got[7, 7]
    assert (hit["n_base"], hit["first_word"], hit["last_word"], hit["base_labels"]) == (2, 3, 5, "mit")
    assert hit["labels"] == "mit,mit-notice" and hit["score"] == 1.0
    assert got[5, 60_000]["n_base"] == 0
    assert license_scan.license_scan(none).count() == 0


def test_license_phrase_across_blocks(spark):
    words = ["w"] * 400
    for at in (0, license_scan.STRIDE - 1, license_scan.STRIDE - 2, 2 * license_scan.STRIDE, 390):
        words[at:at + 2] = ["cc", "by"]
    row = license_scan.license_scan(docs_of(spark, [(1, " ".join(words), "a")])).first()
    assert (row["n_base"], row["first_word"], row["last_word"]) == (4, 0, 390)  # 62-63 and 63-64 overlap: cc cc by


def test_simhash(rows, none):
    got = simhash.simhash_components(rows).collect()
    want = [(i, brute_fingerprint(t)) for i, t, _ in ROWS]
    assert sorted((r["doc_id"] or 0, r["fp"] % (1 << 64)) for r in got) == sorted((i or 0, f) for i, f in want)
    assert {r["doc_id"]: r["component"] for r in got if r["doc_id"] in (1, 2, 3)} == {1: 1, 2: 1, 3: 1}
    assert simhash.simhash_components(none).count() == 0


@pytest.mark.parametrize(("radius", "hot", "chunk"), [(3, 128, 1024), (3, 2, 3), (7, 4, 5)])
def test_links_connect_like_all_pairs(spark, radius, hot, chunk):
    """Clusters of near fingerprints, larger than the hot bucket and the chunk, and single ones."""
    rng = np.random.default_rng(5)
    fps = set(rng.integers(-2**63, 2**63 - 1, 150).tolist())
    for centre in list(fps)[:4]:
        for _ in range(40):
            flips = rng.choice(64, rng.integers(1, radius + 2), replace=False)
            fps.add(int(np.int64(centre) ^ np.bitwise_xor.reduce(np.left_shift(np.uint64(1), flips.astype(np.uint64))).astype(np.int64)))
    fps = sorted(fps)
    links = simhash.link_fingerprints(spark.createDataFrame([(f,) for f in fps], "fp bigint"), radius, hot, chunk)
    got = {r["node"]: r["component"] for r in graph.components(links).collect()}
    want = brute_components(fps, [f % (1 << 64) for f in fps], radius)
    assert {f: got.get(f, f) for f in fps} == want
    assert all(bin((a ^ b) % (1 << 64)).count("1") <= radius for a, b in links.collect())


def test_plans_cover_the_radius():
    rng = np.random.default_rng(1)
    bits = (rng.random((500, 64)) < rng.random(64)).astype(float)
    for n in (0, 500, 10**6, 10**10):
        for radius in (3, 7):
            plan = simhash.make_plan(n, bits.T @ bits * (n / 500), radius)
            assert sorted(b for p in plan.parts for b in p) == list(range(64))
            assert sum(plan.thresholds) >= radius - len(plan.parts) + 1


def test_near_duplicates(spark, none):
    rng = np.random.default_rng(3)
    base = [f"w{x}" for x in rng.integers(0, 5000, 300)]
    near = [*base[:150], "changed", *base[151:]]
    other = [f"v{x}" for x in rng.integers(0, 5000, 300)]
    rows = [(4, " ".join(base), "a"), (2, " ".join(near), "a"), (3, " ".join(base), "b"), (9, " ".join(other), "a"), (9, " ".join(other), "a"),
            (20, "", "a"), (21, None, "a"), (None, " ".join(base), "a")]
    rows += [(100 + k, " ".join([*base[:k], "zz", *base[k + 1:]]), "a") for k in range(20, 280, 4)]
    docs = docs_of(spark, rows)
    for chunk in (256, 8):
        kept = simhash.drop_near_duplicates(docs, chunk=chunk)
        assert kept.columns == docs.columns
        assert sorted(r["doc_id"] for r in kept.collect()) == [2, 9, 20]
    assert simhash.drop_near_duplicates(none).count() == 0


def test_components(spark):
    links = spark.createDataFrame([(i + 1, i) for i in range(300)] + [(1000, 999), (999, 1000), (5, 5)], "a bigint, b bigint")
    got = {r["node"]: r["component"] for r in graph.components(links).collect()}
    assert got == {**{i: 0 for i in range(301)}, 999: 999, 1000: 999}
    assert graph.components(links.limit(0)).count() == 0


def test_sharding(spark, rows, none):
    got = sharding.assign_shards(rows, ["doc_id"], shard_col="score", slot_col="slot")
    assert set(got.columns) == {*rows.columns, "slot"} and got.count() == len(ROWS)
    assert sharding.assign_shards(none, ["doc_id"]).count() == 0
    table = sharding.lookup_table([f"s{k}" for k in range(7)], 251)
    counts = np.bincount(table)
    assert counts.max() - counts.min() <= 1
    fewer = sharding.lookup_table([f"s{k}" for k in range(6)], 251)
    assert (table[table != 6] != fewer[table != 6]).mean() < 0.25
    slow = [-1] * 11
    assert -1 not in sharding.lookup_table(["a", "b"], len(slow))
    for bad in ([], ["a", "a"]):
        with pytest.raises(ValueError):
            sharding.lookup_table(bad, 11)
    with pytest.raises(ValueError):
        sharding.lookup_table(["a"], 10)


def test_topk(spark):
    schema = "vec_id bigint, embedding array<float>, score int, id int"
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5], 1, 1), (1, [1.0, 0.5], 1, 1), (2, [1.0, 0.5], 1, 1), (2, [1.0, 0.5], 1, 1), (3, None, 1, 1), (4, [1.0, None], 1, 1),
            (5, [nan, 1.0], 1, 1), (6, [inf, 1.0], 1, 1), (None, [1.0, 1.0], 1, 1), (7, [0.1, -0.3], 1, 1), (8, [1.0, 2.0, 3.0], 1, 1), (100, [-0.0005, 2.0], 1, 1)]
    vectors = spark.createDataFrame(rows, schema)
    got = [tuple(r) for r in topk.top_k(vectors.filter("vec_id % 100 = 0"), vectors, k=3).orderBy("query_id", "rank").collect()]
    one = 1024 * 1024 + 512 * 512
    assert got == [(0, 1, 1, one), (0, 2, 2, one), (0, 3, 2, one), (100, 1, 0, 1047552), (100, 2, 1, 1047552), (100, 3, 2, 1047552)]
    empty = spark.createDataFrame([], schema)
    assert topk.top_k(vectors, empty).count() == 0 and topk.top_k(empty, vectors).count() == 0


@pytest.mark.parametrize("rows_per_round", [4096, 3])
def test_topk_is_exact_beyond_doubles(spark, monkeypatch, rows_per_round):
    """Scores near 2**60 that differ in their last digits, over several rounds."""
    monkeypatch.setattr(topk, "QUERY_BLOCK", rows_per_round)
    rng = np.random.default_rng(8)
    base = rng.integers(-(10**8), 10**8, 40)
    rows = [(i, [float(x) / 1024 * 1024 / 1024 for x in base + rng.integers(-3, 4, 40)]) for i in range(300)]
    vectors = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk.top_k(vectors.filter("vec_id % 30 = 0"), vectors, k=4).collect()}
    whole = {i: [int(np.floor(x * 1024)) for x in v] for i, v in rows}
    for q in range(0, 300, 30):
        want = sorted((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q)[:4]
        assert [got[q, r + 1] for r in range(4)] == [(i, -s) for s, i in want]


def test_labelled_rows_with_repeated_ids_and_clashing_names(spark):
    from pagetone.llm.common import labelled_rows

    docs = spark.createDataFrame([(1, "one", 5, 6, 7)] * 50 + [(2, "two", 5, 6, 7), (3, None, 5, 6, 7), (None, "x", 5, 6, 7)],
                                 "doc_id bigint, text string, label int, __key int, toxic int")
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (3, 0), (None, 1), (9, 1)], "doc_id bigint, toxic int")
    got = labelled_rows(docs, labels, "toxic", F.lit(True), {1: 100, 0: 100}).collect()
    assert sorted((r["text"] or "", r["label"]) for r in got) == [("", 0), ("one", 1), ("two", 0)]


def test_topk_prunes_exactly(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(700, 40)) * np.linspace(1, 0.01, 40)
    x[100:160] = x[7]
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>").repartition(5)
    q = np.floor(1024 * x).astype(np.int64)
    got = topk.top_k(vectors.filter("vec_id % 50 = 0"), vectors, k=10).collect()
    for i in range(0, 700, 50):
        s = q @ q[i]
        want = sorted((j for j in range(700) if j != i), key=lambda j: (-s[j], j))[:10]
        assert [r["vec_id"] for r in sorted((r for r in got if r["query_id"] == i), key=lambda r: r["rank"])] == want


def test_classifiers(spark, rows, none):
    labelled = spark.createDataFrame([("good calm words here", 0)] * 8 + [("you utter idiot here", 1)] * 8 + [(None, 1), ("x", None)], "text string, label int")
    for module in (toxicity, quality):
        got = module.classify(rows, labelled)
        assert set(got.columns) == {*rows.columns, "predicted"} and got.count() == len(ROWS)
        assert all(0 <= r["score"] <= 1 for r in got.collect())
        assert module.classify(none, labelled).count() == 0
        assert {r["score"] for r in module.classify(rows, labelled.limit(0)).collect()} == {0.5}


def test_toxicity_tolerates_gaps():
    clean = [f"a calm note about what an odd sight in gardens and weather number {i} with kind people" for i in range(60)]
    toxic = [f"a calm note {i}. what an {w} about gardens" for i in range(30) for w in ("idiot", "moron")]
    model = toxicity.fit_rows(clean + toxic, [0] * 60 + [1] * 60)
    plain, gapped, spaced, kind = toxicity._tops(model, ["idiot", "idxiot", "i d i o t", "gardener"], {})
    assert min(plain, gapped, spaced) > kind
    assert model.slope * plain + model.offset > 0.85 > 0 > model.slope * kind + model.offset


def test_decontaminate(spark, rows, none):
    item = " ".join(f"q{i}" for i in range(30))
    edited = " ".join("zz" if i == 12 else f"Q{i}" for i in range(30))
    half = " ".join(f"q{i}" for i in range(15))
    bench = spark.createDataFrame([(7, item), (8, "too short"), (9, None), (10, ""), (7, item)], "item_id bigint, text string")
    docs = docs_of(spark, [*ROWS, (20, f"before it, {item} after", "a"), (21, item.upper(), "a"), (22, f"a b {edited} c", "a"), (23, half, "a"),
                           (24, f"{item} {item}", None), (20, f"before it, {item} after", "a")])
    got = decontaminate.decontaminate(docs, bench).collect()
    assert len(got) == len(ROWS) + 6
    assert {r["doc_id"]: r["items"] for r in got if r["contaminated"]} == {20: "7", 21: "7", 22: "7", 24: "7"}
    assert {r["doc_id"]: round(r["similarity"], 3) for r in got if r["contaminated"]} == {20: 1.0, 21: 1.0, 22: round(21 / 26, 3), 24: 1.0}
    left = decontaminate.drop_contaminated(docs, bench)
    assert left.columns == docs.columns and left.count() == len(ROWS) + 1
    assert decontaminate.decontaminate(none, bench).count() == 0
    assert not any(r["contaminated"] for r in decontaminate.decontaminate(docs, bench.limit(0)).collect())


def test_simhash_lanes(spark):
    import random

    random.seed(4)
    words = [f"t{random.randrange(50)}" for _ in range(333)]
    row = spark.createDataFrame([(words,)], "w array<string>").select(
        F.transform("w", lambda w: F.xxhash64(w)).alias("h"), decontaminate.simhash(F.col("w")).alias("fp")).first()
    want = sum(1 << b for b in range(64) if 2 * sum((h % (1 << 64)) >> b & 1 for h in row["h"]) > len(words))
    assert row["fp"] % (1 << 64) == want


def test_notices_need_the_words_that_name_them(spark):
    rows = [(1, "the music was released in may under the wing of a driving license that was renewed", "a"), (2, "Released under the MIT license.", "a"),
            (3, "this work is licensed under the general public license version", "a"),
            (4, "this work is licensed under the gnu general public license, version", "a")]
    got = {r["doc_id"]: r["labels"] for r in license_scan.license_scan(docs_of(spark, rows)).collect()}
    assert got == {1: "", 2: "mit,mit-notice", 3: "", 4: "gpl,gpl-notice"}


def test_token_files(spark, rows, none, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    tricky = [(30, "a  b   c", "a"), (31, "tail  ", "a"), (32, " \n x\t y \n\nz", "a"), (33, "don't <|endoftext|> 12 ab12.", "a"), (34, "　wide \xa0 é", "a"),
              (35, " lead", "a"), (36, "one two.\nThree, four", "a"), (37, "x ", "a")]
    docs = docs_of(spark, ROWS + tricky)
    manifest = token_files.write_tokens(docs, path, str(tmp_path / "tokens"), parts=3)
    got = token_files.read_tokens(manifest, with_ids=True).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == sorted((i for i, *_ in ROWS + tricky), key=lambda i: -1 if i is None else i)
    assert got[0]["start"] == 0 and all(b["start"] == a["start"] + a["n_tokens"] for a, b in zip(got, got[1:], strict=False))
    texts = {i: t for i, t, _ in ROWS + tricky}
    for r in got:
        assert list(r["ids"]) == [*tokenizer.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids, 0]
    nothing = token_files.write_tokens(none, path, str(tmp_path / "nothing"))
    assert token_files.read_tokens(nothing).count() == 0


def test_mixing(spark, rows, none):
    docs = docs_of(spark, [(i, "w " * (i % 7), s) for i in range(400) for s in ("b", "a", None, "c") if i % 3 or s != "c"] + ROWS)
    out, slots = mixing.mix(docs)
    got = out.collect()
    assert len(got) == docs.count() and all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    assert slots.agg(F.sum("words")).first()[0] == sum(r["taken"] for r in got)
    again = mixing.mix(docs.repartition(7))[0].collect()
    key = lambda r: (r["doc_id"] or -1, r["size"], r["source_size"], r["taken"])
    assert sorted(map(key, got)) == sorted(map(key, again))
    copies = mixing.mixed_documents(docs)
    assert copies.columns == docs.columns
    assert mixing.mix(none)[0].count() == 0 and mixing.mixed_documents(none).count() == 0
    assert mixing.mix(docs_of(spark, [(1, "", "a"), (2, None, None)]))[0].agg(F.sum("taken")).first()[0] == 0


def test_schedule_decides_what_is_taken_and_where(spark, monkeypatch):
    """Every stretch of the mix is near the weights; without the schedule's order it is not."""
    docs = docs_of(spark, [(i, "w " * (20 + i % 50), "abc"[i % 3]) for i in range(1500)])
    weights = {"a": 5.0, "b": 2.0, "c": 1.0}
    out, slots = mixing.mix(docs, weights=weights)
    rows = slots.collect()
    total = out.select("source_size").distinct().agg(F.sum("source_size")).first()[0]
    by_source = {s: [r for r in rows if r["source"] == s] for s in weights}
    want = mixing.targets({s: out.join(docs.select("doc_id", "source"), "doc_id").filter(F.col("source") == s).first()["source_size"] for s in weights}, weights)
    for s, mine in by_source.items():
        assert {r["rank"] for r in mine} == set(range(1 + max(r["rank"] for r in mine)))  # its blocks, none left out
        assert 0 <= want[s] - sum(r["words"] for r in mine) < 1 + mixing.BLOCK_TOKENS
    n = 1 + max(r["slot"] for r in rows)
    for lo, hi in ((0, n // 10), (n // 3, n // 3 + n // 20), (n - n // 10, n)):
        part = {s: len({r["slot"] for r in mine if lo <= r["slot"] < hi}) for s, mine in by_source.items()}
        assert all(abs(part[s] - (hi - lo) * want[s] / sum(want.values())) <= 3 for s in weights), (lo, hi, part, total)
    first = {r["doc_id"]: r["first_slot"] for r in out.collect()}
    assert all(first[r["doc_id"]] <= r["slot"] for r in rows)

    mixed = mixing.mixed_documents(docs, weights=weights)
    shown = [r["source"] for r in mixed.collect()]
    tenth = shown[:len(shown) // 10]
    sized = {s: sum(1 for x in tenth if x == s) / len(tenth) for s in weights}
    assert all(abs(sized[s] - want[s] / sum(want.values())) < 0.05 for s in weights), sized

    # A schedule that gives each source its slots in one run takes as much, but is not near the weights anywhere.
    monkeypatch.setattr(mixing, "golden_step", lambda points: 1)
    again = mixing.mixed_documents(docs, weights=weights).collect()
    assert len({r["source"] for r in again[:len(again) // 10]}) == 1


def test_every_point_of_the_circle_is_visited():
    for points in (1, 2, 3, 10, 97, 1024, 99991):
        step = mixing.golden_step(points)
        assert sorted(i * step % points for i in range(points)) == list(range(points))


def test_targets_share_the_excess():
    assert mixing.targets({"a": 10, "b": 100, "c": 100}, {"a": 5, "b": 2, "c": 1}) == pytest.approx({"a": 30, "b": 120, "c": 60})
    assert mixing.targets({}, {}) == {}


PAGE = "<html><head><title>t</title></head><body>{top}<p>own {n} &amp; text</p>{bottom}</body></html>"


def test_html(spark):
    top, bottom = "<p>Site   name</p><div>Shared notice</div>", "<p>Imprint</p>"
    rows = [(n, f"http://h.example/a/{n}", PAGE.format(top=top, n=n, bottom=bottom)) for n in range(12)]
    rows += [(50, "http://solo.example/x", PAGE.format(top=top, n=50, bottom=bottom)), (51, None, "<p>no url"), (52, "http://h.example/z", None), (53, "http://h.example/a/3", rows[3][2]),
             (None, "u", "<article>kept<nav>menu</nav><div class='comments'>c</div></article>"), (54, "", ""),
             (55, "http://q.example/1", "<main><header><h1>Head</h1></header>a<br>b<script>if (1<2) {}</script><!-- x --> c</main><footer>f</footer><form>g</form><div id=cookie-notice>n</div><aside>s</aside>")]
    pages = spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id bigint, url string, html string, page int, lines string")
    got = {r["page_id"]: r for r in html_text.extract_text(pages.repartition(5)).collect()}
    assert len(got) == len(rows)
    assert all(got[n]["text"] == f"own {n} & text" for n in range(12))
    assert got[53]["text"] == "own 3 & text"  # a copy is not the page to compare with
    assert got[50]["text"].split("\n") == ["Site name", "Shared notice", "own 50 & text", "Imprint"]
    assert got[51]["text"] == "no url" and got[52]["text"] == "" and got[54]["n_chars"] == 0
    assert got[None]["text"] == "kept"
    assert got[55]["text"] == "Head\na\nb c"
    assert html_text.extract_text(pages.limit(0)).count() == 0


@pytest.mark.parametrize("page, want", [
    ("<html><head><title>T</title><body><p>x</p>", "x"), ("<html><title>T</title><p>x", "x"), ("<head><meta charset=x>\n<p>body", "body"),
    ("<article><p class='ad'>buy<p>real text<p>more real</article>", "real text\nmore real"),
    ("<p class=ad><b class=ad>buy<div>text</div>", "text"),
    ("<article><section id='notice-of-intent'>a</section><div class='search-results-analysis'>b</div></article>", "a\nb"),
    ("<div class='social-science'>s</div><div class='site-header'>h</div><div id=sidebar-left>f</div>", "s"),
    ("<article><a title=5\">kept</a> too</article>", "kept too"), ("<a title=\"x>y\" href='q>'>z</a>", "z"), ("<p title=\"abc>tail", "tail"),
])
def test_markup_as_authors_leave_it(page, want):
    assert "\n".join(t for t, role in html_text.text_lines(page) if role != html_text.FRAME) == want


def test_frame_of_neighbours():
    """Head and tail of the nearer page, what both have anywhere; near copies decide nothing alone."""
    line = np.array
    assert html_text.frame_of(line([1, 2, 10, 3]), line([1, 2, 11, 3]), line([1, 5, 12, 3])) == [0, 1, 3]
    assert html_text.frame_of(line([1, 10, 7, 11, 3]), line([1, 20, 7, 21, 3]), line([1, 30, 31, 3])) == [0, 4]  # a quotation of the nearer page
    assert html_text.frame_of(line([1, 10, 7, 11, 3]), line([1, 20, 7, 21, 3]), line([1, 30, 7, 31, 3])) == [0, 2, 4]
    copy = line([1, 10, 11, 12, 13, 98, 3])  # another date
    assert html_text.frame_of(line([1, 10, 11, 12, 13, 99, 3]), copy, line([1, 40, 41, 3])) == [0, 6]
    assert html_text.frame_of(line([1, 10, 11, 12, 13, 99, 3]), copy, None) == []
    assert html_text.frame_of(line([1, 2, 10, 3]), None, None) == []


def test_articles_without_the_tag_stay_whole(spark, sf_dir):
    """With every article tag made a plain block, differencing takes no line of an article."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    whole = {r["page_id"]: [t for t, role in html_text.text_lines(r["html"]) if role == html_text.ARTICLE] for r in pages.collect()}
    plain = pages.withColumn("html", F.regexp_replace("html", "(?i)<(/?)article", "<$1div"))
    got = {r["page_id"]: r["text"].split("\n") for r in html_text.extract_text(plain).collect()}
    assert sum(len(v) for v in whole.values()) > 0
    assert {k: [t for t in v if t not in got[k]] for k, v in whole.items() if any(t not in got[k] for t in v)} == {}


def test_shared_lines_is_longest():
    rng = np.random.default_rng(0)
    for _ in range(200):
        a, b = rng.integers(0, 6, rng.integers(0, 12)), rng.integers(0, 6, rng.integers(0, 12))
        got = html_text.shared_lines(a, b)
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                table[i + 1, j + 1] = table[i, j] + 1 if a[i] == b[j] else max(table[i, j + 1], table[i + 1, j])
        assert got == sorted(set(got)) and len(got) == table[-1, -1]
        it = iter(b.tolist())
        assert all(x in it for x in a[got].tolist())


def brute_near_groups(rows, share=0.8):
    """Smallest key of every row's group by the Jaccard similarity of all pairs of five-word shingle sets."""
    sets = [{tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} for w in (t.lower().split() for _, t in rows)]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= share * len(sets[i] | sets[j]) - 1e-9 and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    return {k: min(rows[j][0] for j in range(len(rows)) if group[j] == group[i]) for i, (k, _) in enumerate(rows)}


@pytest.mark.parametrize("hot", [32, 3])
def test_near_duplicates_like_all_pairs(spark, hot):
    """Appended, cut and edited copies around the threshold, whose fingerprints differ in many bits."""
    rng = np.random.default_rng(11)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 4000, n)]
    rows, passage = [], word(40)
    for k in range(12):
        base = [*word(120), *passage]
        rows += [base, base + word(30), base + ["same"] * 38, base + word(60), base[:135], base[:120], base[25:]]
        for n in (3, 6, 9):
            edited = list(base)
            for at in rng.choice(len(base), n, replace=False):
                edited[at] = "zz"
            rows.append(edited)
    rows = [(k, " ".join(w)) for k, w in enumerate(rows)]
    want = brute_near_groups(rows)
    assert 12 < len(set(want.values())) < len(rows)
    kept = simhash.drop_near_duplicates(docs_of(spark, [(k, t, "a") for k, t in rows]), hot=hot, chunk=7)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want.values()))


def brute_items(text, items):
    """(item, similarity) of all windows of every item's size that hold 80 % of its five-word shingles, repeats counted."""
    from collections import Counter

    found = {}
    w = text.lower().split()
    for key, item in items:
        v = item.lower().split()
        want = Counter(tuple(v[i:i + 5]) for i in range(len(v) - 4))
        for s in range(max(0, len(w) - len(v)) + 1):
            part = w[s:s + len(v)]
            share = (want & Counter(tuple(part[i:i + 5]) for i in range(len(part) - 4))).total() / want.total()
            if share >= 0.8:
                found[key] = max(found.get(key, 0), share)
    return found


def test_decontaminate_like_all_windows(spark):
    """Items quoted with a cut end, a replaced run, a shift, single edits, repeats, and in texts shorter than they are."""
    rng = np.random.default_rng(7)
    word = lambda n, of: [f"{of}{x}" for x in rng.integers(0, 3000, n)]
    items = [(k, word(n, "q")) for k, n in enumerate([5, 6, 15, 15, 20, 25, 30, 40, 50, 60, 60])] + [(90, ["a", "b"] * 14), (91, ["one"] * 12)]
    texts = [" ".join(["a", "b"] * 12), " ".join(["one"] * 11), " ".join(["one"] * 40), "b " + " ".join(["a", "b"] * 30)]
    for _, v in items:
        lost = int((len(v) - 4) * 0.2 + 1e-9)
        for cut in (0, lost, lost + 1):
            around = word(20, "x"), word(70, "y")
            texts += [" ".join([*around[0], *v[:len(v) - cut], *around[1]]), " ".join([*around[0], *v[cut:], *around[1]]), " ".join(v[cut:])]
            run = list(v)
            run[len(v) // 2:len(v) // 2 + max(0, cut - 4)] = word(max(0, cut - 4), "z")
            texts.append(" ".join([*around[0], *run, *around[1], *v]))
            texts.append(" ".join([*around[0], *run, *around[1]]))
    items = [(k, " ".join(v)) for k, v in items]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = decontaminate.decontaminate(docs_of(spark, [(k, t, "a") for k, t in enumerate(texts)]), bench).collect()
    want = {k: brute_items(t, items) for k, t in enumerate(texts)}
    assert {r["doc_id"]: (r["items"], round(r["similarity"], 6)) for r in got} == {
        k: (",".join(map(str, sorted(f))), round(max(f.values(), default=0), 6)) for k, f in want.items()}


@pytest.mark.parametrize("limit", [0, 10**6])
def test_decontaminate_many_items(spark, monkeypatch, limit):
    """Item texts under several keys are looked for once; shingles beyond the limit of the broadcast meet a bitmap before the shuffle."""
    monkeypatch.setattr(decontaminate, "BROADCAST_SHINGLES", limit)
    rng = np.random.default_rng(11)
    line = " ".join(f"l{x}" for x in rng.integers(0, 40, 12))
    items = [(k, " ".join(f"q{x}" for x in rng.integers(0, 900, 8 + k))) for k in range(12)] + [(50, f"{line} {line}"), (51, f"{line} once more")]
    items += [(k + 100, t) for k, t in items] + [(3, "another text of the same key as before")]
    texts = [f"some words {t} and more" for _, t in items] + [" ".join([line] * 40), " ".join(items[7][1].split()[:13]), "nothing at all", ""]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    kept = decontaminate.benchmark_items(bench)
    assert kept.count() == 29 and kept.select("id").distinct().count() == 15
    docs = docs_of(spark, [(k, t, "a") for k, t in enumerate(texts)])
    shared = decontaminate._shared(docs.selectExpr("doc_id AS row", "text"), kept.selectExpr("id", "hashes", "size(hashes) AS need", "1 AS kinds").distinct())
    plan = shared._jdf.queryExecution().optimizedPlan().toString()
    assert ("scalar-subquery" in plan) == (limit == 0) and ("strategy=broadcast" in plan) == (limit > 0)
    got = decontaminate.decontaminate(docs, bench).collect()
    want = {k: {i: max(s for j, s in ((key, brute_items(t, [(key, v)]).get(key, 0)) for key, v in items) if j == i) for i, _ in items} for k, t in enumerate(texts)}
    want = {k: {i: s for i, s in f.items() if s} for k, f in want.items()}
    assert {r["doc_id"]: (r["items"], round(r["similarity"], 6)) for r in got} == {
        k: (",".join(map(str, sorted(f))), round(max(f.values(), default=0), 6)) for k, f in want.items()}


@pytest.mark.parametrize("parts", [1, 12])
def test_html_runs_of_copies(spark, parts):
    """Copies of one page beside each other, in a longer run than any range holds, all lose the site's lines."""
    page = "<body><p>Site name</p><p>own {n}</p><p>Imprint</p></body>"
    rows = [(n, f"http://h.example/a/{n:03}", page.format(n=n if n < 5 or n >= 65 else "copy")) for n in range(70)]
    rows += [(100 + n, f"http://only.example/{n}", page.format(n="copy")) for n in range(9)]
    rows += [(200 + n, f"http://q.example/p?q={n}", page.format(n="one")) for n in range(25)] + [(300, "http://q.example/z", page.format(n="z"))]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    held = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = {r["page_id"]: r["text"] for r in html_text.extract_text(pages).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", held)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(got) == len(rows)
    assert all(got[n] == (f"own {n}" if n < 5 or n >= 65 else "own copy") for n in range(70))
    assert all(got[100 + n] == "Site name\nown copy\nImprint" for n in range(9))  # no page to compare with
    assert all(got[200 + n] == "own one" for n in range(25)) and got[300] == "own z"


@pytest.mark.parametrize(("html", "kept"), [
    ('<div style="overflow:hidden">a</div>', "a"), ('<p>see <a href="/hidden/x">b</a></p>', "see b"), ('<p title="a hidden truth">c</p>', "c"),
    ("<article><div style='visibility: hidden'>d</div></article>", "d"), ("<div data-hidden=no>e</div>", "e"),
    ('<div hidden>x</div><p hidden="">x</p><p title=\'a\' HIDDEN>x</p><div aria-hidden="true">x</div>f', "f"),
    ('<div class="content no-sidebar">g</div><div class="with-sidebar">h</div><div id=has-header>i</div>', "g h i"),
    ('<div class="layout-without-nav">j</div><div class="content sidebar">x</div><div class=site-header>x</div>', "j"),
    ('<div class="widget">x<article>k<div class=share>x</div></article>x</div>l', "k l"),
    ('<div class="page header"><div role="main">m</div><main>n</main></div>', "m n"),
    ('<div class="comments"><nav><article>x</article></nav></div><div role=search class=a><main>x</main></div>o', "o"),
    ('<div class="banner" role="article">p</div>', "p")])
def test_html_declared_frame(html, kept):
    assert " ".join(t for t, r in html_text.text_lines(f"<body>{html}</body>") if r != html_text.FRAME) == kept


def test_pipeline_stages_like_brute_force(spark, tmp_path):
    """The registered stages after the classifier, one by one, each on what the one before left."""
    from collections import Counter
    from math import floor

    import corpus_pipeline

    rng = np.random.default_rng(13)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 4000, n)]
    items = [(k, word(n)) for k, n in enumerate([15, 30, 60])]
    texts = []
    for k in range(20):
        base = word(100)
        texts += [base, base + word(18), base[:85], base + word(40)]
        part = items[k % 3][1]
        texts.append([*word(60), *part[:len(part) - int((len(part) - 4) * 0.2)], *word(50)])
    rows = [(k, " ".join(w), "abc"[k % 7 % 3]) for k, w in enumerate(texts)]
    text, source = {k: t for k, t, _ in rows}, {k: s for k, _, s in rows}
    bench = [(k, " ".join(w)) for k, w in items]
    spark.createDataFrame(bench, "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    stages, docs = dict(corpus_pipeline.STAGES), docs_of(spark, rows)

    docs = stages["near_dedup"](spark, docs, str(tmp_path)).checkpoint()
    kept = sorted(r["doc_id"] for r in docs.collect())
    assert kept == sorted(set(brute_near_groups([(k, t) for k, t, _ in rows]).values())) and len(kept) < len(rows)

    docs = stages["decontamination"](spark, docs, str(tmp_path)).checkpoint()
    clean = sorted(r["doc_id"] for r in docs.collect())
    assert clean == [k for k in kept if not brute_items(text[k], bench)] and len(clean) < len(kept)

    docs = stages["mixing"](spark, docs, str(tmp_path)).checkpoint()
    times = Counter(r["doc_id"] for r in docs.collect())
    size = {k: len(text[k].split()) for k in clean}
    total = {s: sum(size[k] for k in clean if source[k] == s) for s in "abc"}
    for s, target in mixing.targets(total, {"a": 5.0, "b": 2.0, "c": 1.0}).items():
        own = [k for k in clean if source[k] == s]
        whole = max(0, floor(target) - mixing.BLOCK_TOKENS) // total[s]
        assert all(whole <= times[k] <= whole + 2 for k in own)
        assert -mixing.BLOCK_TOKENS <= sum(times[k] * size[k] for k in own) - floor(target) < max(size[k] for k in own)

    assert Counter(r["doc_id"] for r in stages["sharding"](spark, docs, str(tmp_path)).collect()) == times
