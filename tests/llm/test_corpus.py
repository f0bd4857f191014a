"""Preference pairs, mixing, quality, near duplicates, page text and the pipeline on small fixtures."""

import random
import weakref
import zlib
from fractions import Fraction

import pytest
import xxhash
from pyspark.sql import functions as F

from paneloom.llm import chunks, jaccard_join, mixing, preference, quality, templates

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed, n):
    draw = random.Random(seed)
    return " ".join(draw.choice(WORDS) + str(draw.randint(0, 50)) for _ in range(n))


def test_preferences(spark):
    turns = [
        (1, 0, "system", "s"), (1, 1, "user", "q"), (1, 2, "assistant", "a1"), (2, 0, "user", "q"), (2, 1, "assistant", None),
        (3, 0, "user", "no answer"), (4, None, None, "x"), (4, 1, "assistant", "a4"), (4, 1, "assistant", "a4"), (None, 0, "user", "lost"),
    ]
    frame = spark.createDataFrame([(*t, "extra") for t in turns], "conv_id long, turn long, role string, text string, place string")
    numbered = preference.numbered_turns(frame)
    got = {(r["pair_id"], r["part"], r["place"]): (r["rendered"], r["trained"]) for r in preference.format_preferences(preference.answers_exchanged(numbered)).collect()}
    assert got[1, "prompt", 2] == ("<|im_start|>user\nq<|im_end|>\n", False)
    assert got[1, "chosen", 3] == ("<|im_start|>assistant\na1<|im_end|>\n", True)
    assert got[1, "rejected", 3] == ("<|im_start|>assistant\n<|im_end|>\n", True)
    # conversation 4 ends with its null turn
    assert {k[0] for k in got} == {1, 2}
    pairs = spark.createDataFrame([(7, 1, 3), (8, 1, 1), (9, 2, 99)], "pair_id long, chosen_id long, rejected_id long")
    rows = preference.format_preferences(preference.sides_of_pairs(numbered, pairs)).collect()
    assert {(r["part"], r["place"]) for r in rows if r["pair_id"] == 7} == {("chosen", 1), ("chosen", 2), ("chosen", 3), ("rejected", 1)}
    assert {r["part"] for r in rows if r["pair_id"] == 8} == {"prompt"}
    assert {r["part"] for r in rows if r["pair_id"] == 9} == {"chosen"}
    assert preference.format_preferences(preference.answers_exchanged(preference.numbered_turns(frame.limit(0)))).count() == 0


def quotas_by_listing(targets, most, total):
    """Seats one by one to the highest quotient."""
    won = [0] * len(targets)
    for _ in range(total):
        best = max((i for i in range(len(targets)) if won[i] < most[i]), key=lambda i: (Fraction(targets[i]) / (2 * won[i] + 1), -i))
        won[best] += 1
    return won


def test_quotas_follow_the_highest_quotients(spark):
    sizes = [1000, 10, 0, 333, 5000, 64]
    targets = [700.5, 20.0, 0.0, 666.0, 2100.25, 64.0]
    frame = spark.createDataFrame([(str(i), s, i + 1, t) for i, (s, t) in enumerate(zip(sizes, targets, strict=True))], "source string, source_size long, place long, target double")
    rows = mixing.shard_quotas(frame, 32, 4).collect()
    total = round(sum(targets) / 32)
    most = [2 * -(-s // 32) for s in sizes]
    for shard in range(4):
        want = quotas_by_listing(targets, most, total * (shard + 1) // 4)
        assert [r["upto"] for r in sorted(rows, key=lambda r: r["place"]) if r["shard"] == shard] == want
    assert sum(r["quota"] for r in rows) == total and min(r["quota"] for r in rows) >= 0


def test_mixing(spark, documents):
    rows = [(i, prose(i, 20 + i % 50), "abc"[i % 3]) for i in range(120)]
    rows += [(200 + i, prose(1, 40), "hot") for i in range(150)] + [(500, None, None), (501, "", "a"), (None, "one two", None), (None, "one two", None)]
    frame = documents(rows)
    got = mixing.mix(frame).collect()
    assert len(got) == len(rows)
    sizes, taken, targets = {}, {}, {}
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        targets[r["source"]] = r["target"]
    weight = dict(zip(["a", "b", "c", "hot", None], [3, 1, 2, 3, 1], strict=True))
    want, free, left = {}, set(sizes), 1.5 * sum(sizes.values())
    while free:  # share, stop at twice the size, share again
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > 2 * sizes[s]}
        if not over:
            want |= {s: weight[s] * level for s in free}
            break
        want |= {s: 2.0 * sizes[s] for s in over}
        left -= sum(2 * sizes[s] for s in over)
        free -= over
    assert all(abs(targets[s] - want[s]) < 1e-6 for s in sizes)
    assert all(abs(taken[s] - want[s]) <= 2 * mixing.BLOCK_WORDS for s in sizes)
    again = {(r["doc_id"], r["size"], r["taken"]) for r in mixing.mix(frame.repartition(7)).collect()}
    assert again == {(r["doc_id"], r["size"], r["taken"]) for r in got}
    made = mixing.mixed_documents(frame)
    assert made.columns == frame.columns
    words = {}
    for r in made.collect():
        words[r["source"]] = words.get(r["source"], 0) + len(r["text"].split())
        assert r["n_chars"] == len(r["text"])
    assert words == {s: n for s, n in taken.items() if n}
    assert mixing.mix(documents([])).count() == 0 and mixing.mixed_documents(documents([])).count() == 0


def test_quality(spark, documents):
    rows = [(i, prose(i, 200) if i % 3 else " | ".join(prose(i, 120).upper().split()) + " $$$ %%%" * 30, "s") for i in range(240)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), "x") for i in range(200)] + [(None, 1, "x"), (7, None, "x"), (9999, 0, "x")], "doc_id long, quality int, text string")
    more = rows + [(900, None, "s"), (901, "", "s"), (None, "x", "s"), (5, rows[5][1], "s"), (902, prose(3, 60_000), "s")]
    frame = documents(more)
    model = quality.fit(frame, labels)
    got = {}
    for r in quality.score(frame, model).collect():
        got.setdefault(r["doc_id"], []).append(r["score"])
    assert sum(map(len, got.values())) == len(more) and all(0 <= s <= 1 for v in got.values() for s in v)
    held = range(200, 240)
    assert sum((got[i][0] >= 0.3) == bool(i % 3) for i in held) >= 38
    assert got[900] == got[901] and got[5][0] == got[5][1] and got[902][0] >= 0.3
    kept = quality.accepted(frame, model, 0.3)
    assert kept.columns == frame.columns and kept.count() == sum(s >= 0.3 for v in got.values() for s in v)
    one = quality.fit(frame, labels.filter("quality = 1"))
    assert {r["score"] >= 0.99 for r in quality.score(frame, one).collect()} == {True}
    none = quality.fit(documents([]), labels.limit(0))
    assert {round(r["score"], 6) for r in quality.score(frame, none).collect()} == {0.5}


def test_scores_equal_a_plain_recomputation(documents, spark):
    import math

    import zstandard

    rows = [(i, prose(i, 60) + (" é ü 漢字" if i % 2 else " buy now !!!"), "s") for i in range(120)] + [(500, "é" * 3000, "s"), (501, None, "s"), (502, prose(1, 2500), "s")]
    frame = documents(rows)
    labels = spark.createDataFrame([(i, i % 2) for i in range(120)], "doc_id long, quality int")
    model = quality.fit(frame, labels)
    assert 0 < len(model.good) <= quality.DICTIONARY_BYTES and 0 < len(model.bad) <= quality.DICTIONARY_BYTES

    def size(block, words):
        options = {"level": quality.LEVEL, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
        return len(zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(words, dict_type=zstandard.DICT_TYPE_RAWCONTENT), **options).compress(block))

    texts = {i: (t or "").encode() for i, t, _ in rows}
    for r in quality.score(frame.withColumn("difference", F.lit("x")).withColumn("label", F.lit("y")), model).collect():
        blocks = [texts[r["doc_id"]][k : k + quality.BLOCK_BYTES] for k in range(0, len(texts[r["doc_id"]]), quality.BLOCK_BYTES)]
        saved = sum(size(b, model.bad) - size(b, model.good) for b in blocks) / max(1, len(texts[r["doc_id"]]))
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-(model.intercept + model.slope * saved))), abs=1e-12)


def test_dictionary_pieces_are_cut_by_bytes(documents, spark, monkeypatch):
    monkeypatch.setattr(quality, "DICTIONARY_BYTES", 900)
    frame = documents([(i, ("漢字" if i % 2 else "ab ") * 400, "s") for i in range(60)])
    model = quality.fit(frame, spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int"))
    # every sampled document has its share: 20 of each class, with a line end between them
    assert model.good.count(b"\n") == 19 and model.bad.count(b"\n") == 19 and 700 <= len(model.good) <= 900


def gram_set(text):
    words = (text or "").lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def test_near_duplicates(spark, documents):
    rows = []
    for g in range(12):
        base = prose(g, 120).split()
        for c in range(g):  # near copies, some beyond the threshold of each other
            own = list(base)
            for k in range(c % 6):
                own[(17 * (k + 1) * (c + 1)) % len(own)] = f"edit{c}x{k}"
            rows.append((len(rows), " ".join(own), "s"))
    rows += [(len(rows) + i, prose(99, 60), "s") for i in range(30)]
    rows += [(900, None, "s"), (901, "", "s"), (902, " \n", "s"), (903, "Two words", "s"), (904, "two  WORDS", "s"), (905, "two", "s"), (3, rows[3][1], "s"), (None, prose(99, 60), "s"), (906, prose(7, 30_000), "s")]
    sets = [gram_set(t) for _, t, _ in rows]
    links = [[j for j in range(len(rows)) if j != i and sets[i] and sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8] for i in range(len(rows))]
    root = list(range(len(rows)))
    for _ in rows:
        root = [min([root[i], *[root[j] for j in links[i]]]) for i in range(len(rows))]
    names = {}
    for i, (doc_id, _, _) in enumerate(rows):
        if doc_id is not None:
            names[root[i]] = min(names.get(root[i], doc_id), doc_id)
    want = sorted((str(d), names[root[i]], len(links[i])) for i, (d, _, _) in enumerate(rows))
    saved, jaccard_join.BLOCK_NODES = jaccard_join.BLOCK_NODES, 4  # so that buckets are dealt into blocks
    try:
        got = jaccard_join.near_duplicates(documents(rows)).collect()
        assert sorted((str(r["doc_id"]), r["class_id"], r["links"]) for r in got) == want
    finally:
        jaccard_join.BLOCK_NODES = saved
    assert sum(r["keep"] for r in got) == len(set(root))
    kept = jaccard_join.one_of_each(documents(rows))
    assert kept.count() == len(set(root)) and kept.columns == documents(rows).columns
    assert jaccard_join.near_duplicates(documents([])).count() == 0


def test_texts_of_one_id_meet_their_own_node_only(spark, documents):
    rows = [(None if i % 2 else 7, prose(i // 2, 40) + (" more" if i % 4 > 1 else ""), "s") for i in range(120)]
    named = documents(rows).select(F.col("doc_id").alias("id"), "text")
    wanted = named.select("id", F.xxhash64("text").alias("text_hash")).distinct().select(
        F.monotonically_increasing_id().alias("node"), "id", "text_hash", F.lit(0).alias("d1"), F.lit(0).alias("d2")
    )
    assert jaccard_join.texts_of(named, wanted).count() == len(rows)
    copies = documents([(None, prose(k, 60) + end, "s") for k in range(20) for end in ("", " end")])
    assert [r["links"] for r in jaccard_join.near_duplicates(copies).collect()] == [1] * 40


def test_bands_meet_the_recall():
    for threshold in (0.5, 0.8, 0.95):
        bands, rows = jaccard_join.choose_bands(threshold, 0.999)
        assert 1 - (1 - threshold**rows) ** bands >= 0.999 and bands * rows <= jaccard_join.HASHES
    with pytest.raises(ValueError):
        jaccard_join.choose_bands(0.01, 0.999999)


PAGE = """<!DOCTYPE html><html><head><title>no</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><a href=/a>menu %d</a></nav>
<div class="cookie-notice">We use cookies</div><article><h1>Title %d &amp; more</h1><p>First <b>bo</b>ld<br>line%d<p>Second &eacute; paragraph %d.
<div>Share this piece</div><section class="comments"><p>reader says %d</p></section></article><footer>&copy; host</footer></body></html>"""
PLAIN = """<body><div id=x><ul><li><a href=1>one %d</a><li><a href=2>two</a></ul></div><div><p>Text number %d of the page, <a href=q>linked</a> here.</p></div><div>Never miss a thing</div></body>"""


def test_page_text(spark):
    rows = [(i, f"https://www.a.example:80/{i}", PAGE % (i, i, i, i, i)) for i in range(12)] + [(100 + i, f"http://b.example/{i}", PLAIN % (i, i)) for i in range(12)]
    rows += [(200, None, None), (201, "", ""), (202, "nonsense", "<p>&lt;b&gt; open"), (203, "http://c.example/", "plain &amp; simple"), (0, rows[0][1], rows[0][2])]
    rows += [(300 + i, f"http://same.example/{i}", "<article><p>The same text</p><div>x</div></article>") for i in range(12)]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, text string, page long")
    got = templates.extract(frame).collect()
    assert len(got) == len(rows)
    text = {r["page_id"]: r["text"] for r in got}
    assert text[5] == "Title 5 & more First bold line5 Second é paragraph 5."
    assert text[104] == "Text number 4 of the page, linked here."
    assert (text[200], text[201], text[202], text[203]) == ("", "", "<b> open", "plain & simple")
    assert text[301] == "The same text x"
    assert templates.extract(frame.limit(0)).count() == 0


NOTICE = "<html><body><div class=text><p>Body %d of %s.</p></div><div class=last>%s</div></body></html>"


def test_templates_of_layouts(spark):
    layouts = {"one": NOTICE, "two": "<html><body><table><tr><td>Body %d of %s.</td></tr></table><section>%s</section></body></html>"}
    rows = [(i, layouts[k] % (i, k, f"Slogan {k}")) for i, k in enumerate(["one", "two"] * 15)]
    rows += [(100, None), (101, ""), (102, "no markup")]
    repeated = "<html><body><div><p>Body %d.</p><p>%s</p><p>%s</p><p>%s</p></div></body></html>"
    copies = [(200 + i, repeated % (i, *(("a same", "b same", "c same") if i < 10 else (f"a {i}", f"b {i}", f"c {i}")))) for i in range(30)]
    pages = [(i, f"http://l.example/{i}", h) for i, h in rows] + [(i, f"http://r.example/{i}", h) for i, h in copies]
    pages += [(300 + i, None, NOTICE % (i, "none", "Slogan none")) for i in range(12)]
    text = {r["page_id"]: r["text"] for r in templates.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert len(text) == len(pages)
    assert all(text[i] == f"Body {i} of {k}." for i, k in enumerate(["one", "two"] * 15))
    assert (text[100], text[101], text[102]) == ("", "", "no markup")
    assert text[205] == "Body 5. a same b same c same"  # repeated text in one layout is no template
    assert text[303] == "Body 3 of none."


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<div class='layout has-sidebar'><main><p>Text</p></main></div>", "Text"),
        ("<div class='page no-sidebar'><article><p>Text</p></article></div>", "Text"),
        ("<div class='page sidebar'><p>menu</p><main><p>Text</p></main></div>", "Text"),
        ("<div class='page sidebar'><p>menu</p><article><p>Text</p></article></div>", "Text"),
        ("<form><p>menu</p><main><p>Text</p></main></form>", "Text"),
        ("<article class='post comments-open'><p>Text</p></article>", "Text"),
        ("<article><header class='entry-header'><h1>Head</h1></header><p>Text</p></article>", "Head Text"),
        ("<article><div class='article-header'><h1>Head</h1></div><p>Text</p></article>", "Head Text"),
        ("<article><div class='header'><h1>Head</h1></div><p>Text</p></article>", "Head Text"),
        *((f"<article><div class='{name}'>Part</div><p>Text</p></article>", "Part Text") for name in "legal search side tags notice related share".split()),
        ("<article><figure><img><figcaption>Part</figcaption></figure><p>Text</p></article>", "Part Text"),
        ("<div><p>Copyright law is old.</p><p>(c) is a mark.</p><p><a href=x>A linked line</a></p><p>Text</p></div>", "Copyright law is old. (c) is a mark. A linked line Text"),
        ("<div class='next-article'>Next</div><div aria-label='Ads in the search for a banner'><p>Text</p></div>", "Next Text"),
        # what stays out
        ("<article><p>Text</p><div class='comments'><article><p>reader</p></article></div></article>", "Text"),
        ("<article><p>Text</p></article><div class='sidebar'><article><p>teaser</p></article></div>", "Text"),
        ("<div class='comments'><article><p>reader</p></article></div><div><p>Text</p></div>", "Text"),
        ("<div class='site-header'>name</div><div role='search'>find</div><div id='ad-3'>buy</div><nav>go</nav><p>Text</p><div class=footer>end</div>", "Text"),
        ("<header><p>name</p></header><ul><li><a href=1>one</a><li><a href=2>two</a></ul><p>Text</p><aside>more</aside>", "Text"),
    ],
)
def test_marks_are_whole_names(page, want):
    assert templates.main_text(f"<html><body>{page}</body></html>", frozenset()) == want


def test_folds_are_those_of_crc32(spark):
    rows = spark.range(50).select("id", quality.fold(F.col("id")).alias("f")).collect()
    assert all(r["f"] == zlib.crc32(str(r["id"]).encode()) % 5 for r in rows)


def test_pipeline(spark):
    import corpus_pipeline
    from paneloom.llm.shared import stored, table

    folder = "/root/testdata/sf0.001"
    docs = table(spark, folder, "documents")
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES:
        kept.append(stored(stage(spark, kept[-1], folder), f"test-{name}"))
    first, good, unique, mixed, packed = kept
    assert good.columns == unique.columns == mixed.columns == first.columns
    assert 0 < unique.count() <= good.count() < first.count()
    sets = [gram_set(r["text"]) for r in unique.collect()]
    assert not any(len(a & b) / len(a | b) >= 0.8 for i, a in enumerate(sets) for b in sets[:i] if a and b)
    tokens = packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()
    assert max(r["n"] for r in tokens) <= 2048
    assert packed.agg(F.sum("length")).first()[0] == packed.filter("start = 0").agg(F.sum("doc_tokens")).first()[0]
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, folder)
    assert empty.count() == 0


def test_a_worker_keeps_one_operators_tables_and_no_words_of_the_join():
    class Table:
        def __init__(self):
            self.make = lambda: self  # names itself, as an encoder and its caches do

    gone = weakref.ref(chunks.held(("first",), Table))
    assert gone() is not None and chunks.held(("first",), Table) is gone()
    hashes = jaccard_join.word_hashes(["One two one", "", "two\nThree"])
    assert gone() is None and not any(chunks._HELD.values())
    assert [len(h) for h in hashes] == [3, 0, 2] and hashes[0][0] == hashes[0][2] and hashes[0][1] == hashes[2][0]
    assert hashes[2].tolist() == [xxhash.xxh3_64_intdigest(w) for w in (b"two", b"three")]
