"""What the review of the fourth round found."""

import contextlib

from pyspark.sql import functions as F

from topspin.operators import identity

#: Joins by shuffles, whose small partitions adaptive execution joins: how large tables are read.
SHUFFLED = {
    "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2000",
    "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "100", "spark.sql.shuffle.partitions": "16",
}


@contextlib.contextmanager
def configured(spark, values):
    old = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_records_meet_the_players_they_belong_to_when_joins_are_shuffled(spark):
    name = lambda c: F.concat(F.lit("x "), F.md5(c.cast("string")))
    none = F.lit(None).cast("string")
    known = spark.range(0, 400, 2).select("id", name(F.col("id")).alias("name"), none.alias("atp_id"), none.alias("wta_id"))
    incoming = spark.range(1200).select("id", name(F.col("id") % 400).alias("name"), F.lit("atp").alias("source_key"), none.alias("external_id"), none.alias("gender"))
    with configured(spark, SHUFFLED):
        rows = identity.resolve(incoming, known, identity.empty_aliases(spark)).collect()
    assert len(rows) == 1200
    for r in rows:
        who = r.in_id % 400
        assert (r.player_id, r.made_by, r.status) == (who, None, "matched") if who % 2 == 0 else (r.made_by, r.status) == (who, "created" if r.in_id == who else "matched")


def test_suggestions_count_every_similar_player(spark):
    import itertools
    import random

    from topspin.functions.names import name_similarity

    rng = random.Random(4)
    people = [(i, rng.choice(["anna", "annab", "annabe", "annabel", "jo", "j.", "carlos", "hannabel"]) + " " + rng.choice(["smith", "smyth", "lee"])) for i in range(60)]
    people += [(60, ""), (61, "x y"), (62, "x y"), (63, "lone wolf")]
    near = {i: [] for i, _ in people}
    for (i, a), (j, b) in itertools.combinations(people, 2):
        if a and b and a.split()[-1] == b.split()[-1] and (score := name_similarity(*sorted((a, b)))) >= 0.95:
            near[i].append((-score, j))
            near[j].append((-score, i))
    want = {i: (len(x), [(j, round(-s, 4)) for s, j in sorted(x)[:3]]) for i, x in near.items() if len(x) >= 2}
    rows = identity.suggestions(spark.createDataFrame(people, "id long, name string")).collect()
    assert len(rows) == len(want) > 50
    assert {r.id: (r.candidates, [(s.player_id, s.confidence) for s in r.suggested]) for r in rows} == want


def test_plain_pages_give_the_same_tree_by_pattern(monkeypatch):
    import random
    import re
    import time

    from topspin.sources import pages

    def shown(node):
        return node if isinstance(node, str) else (node.tag, node.attrs, [shown(c) for c in node.children])

    def slowly(html):
        with monkeypatch.context() as m:
            m.setattr(pages, "_PLAIN", re.compile("(?!)"))
            return pages.parse(html)

    rng = random.Random(2)
    tags = "div a span table tr td p li ul br img title script nav".split()
    few = lambda plain: [f'<{t} class="x {t}" id="1">' for t in tags] + [f"</{t}>" for t in tags] + [f"<{t}>" for t in tags] + ["a > b", " ", "\n", "é"] + ([] if plain else ["&amp;", "&", "<", "<br/>", "<!-- x -->", "<P class=y>", "</ div>", "<a x>", '<a  b="1">'])
    for n in range(600):
        html = "".join(rng.choices(few(n % 2), k=rng.randint(0, 25)))
        assert shown(pages.parse(html)) == shown(slowly(html)), html
    assert shown(pages.parse(None)) == shown(slowly(None))

    html = '<div class="a"><div class="b"><a href="/x/y">name</a><span>6</span></div></div>' * 2000
    times = []
    for parse in (pages.parse, slowly):
        start = time.perf_counter()
        parse(html)
        times.append(time.perf_counter() - start)
    assert times[0] < times[1] / 1.5


def test_equal_pages_of_a_batch_are_read_once(spark):
    from topspin.sources import pages

    # a reader that gives its count of calls: equal pages show the same one
    def rows(root, seen=[]):  # noqa: B006
        seen.append(1)
        return [(str(len(seen)),)] * 2

    df = spark.createDataFrame([(i, "<p>x</p>" if i % 2 else None) for i in range(10)], "page_id long, html string").coalesce(1)
    got = pages.extract(df, rows, "calls string").collect()
    assert [(r.page_id, r.position) for r in got] == [(i, k) for i in range(10) for k in range(2)] and len({r.calls for r in got}) == 2


def test_names_of_both_sides_have_their_keys_made_once(spark, monkeypatch):
    import itertools
    import random

    rng = random.Random(6)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(1, 24))) for _ in range(60)]
    texts = sorted({" ".join(rng.choices(words, k=rng.randint(1, 4))) for _ in range(90)} | {w + x for w in words[:30] for x in ("", "a")} | {"a", "b", "ab"})
    grams = lambda n: {("  " + w + " ")[i : i + 3] for w in n.split() for i in range(len(w) + 1)}
    asked, known = texts[::2] + texts[1::4], texts[1::2] + texts[::4]
    alike = lambda a, b, t: len(grams(a) & grams(b)) >= t * len(grams(a) | grams(b)) - 1e-12
    table = lambda names: spark.createDataFrame([(n,) for n in names], "name string").select(F.xxhash64("name").alias("id"), "name")
    for threshold in (0.95, 0.9, 0.7):
        for others in (False, True):
            rows = identity._trigram_named(table(asked), table(known), threshold, others).collect()
            got = [(r.left_name, r.right_name) for r in rows if not others or r.left_name != r.right_name]
            assert len(got) == len(set(got)) and set(got) == {(a, b) for a, b in itertools.product(asked, known) if alike(a, b, threshold) and not (others and a == b)}
