"""The cascade against a one-by-one replay of the same rules."""

import random
from datetime import datetime, timedelta, timezone
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from newsloom.operators import dedup, similarity

AS_OF = datetime(2025, 3, 1, tzinfo=timezone.utc)
DDL = "arrival_seq bigint, url_key string, hash_key string, event_key string, title string, published_at timestamp, eligible boolean, confidence double"


def edit(a, b):
    prev = list(range(len(b) + 1))
    for i, ca in enumerate(a, 1):
        cur = [i]
        for j, cb in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (ca != cb)))
        prev = cur
    return 1 - prev[-1] / max(len(a), len(b), 1)


def replay(rows, measure):
    leaders, out = [], {}
    for seq, url, h, ev, title, pub, ok, conf in rows:
        since = (pub or AS_OF) - timedelta(days=7)

        def first(test):
            return next((l for l in leaders if test(l)), None)

        def near(l):
            if l[5] is None or l[5] < since:
                return False
            a, b = l[4].lower(), title.lower()
            s = SequenceMatcher(None, a, b).ratio() if measure == "sequence" else edit(a, b)
            return s >= 0.92

        for stage, test in ((1, lambda l: l[1] == url), (2, lambda l: l[2] == h), (3, near), (0, None), (4, lambda l: l[3] == ev)):
            if stage == 0:
                if not ok:
                    out[seq] = ("skipped", None, None)
                    break
                continue
            hit = first(test)
            if hit:
                names = {1: "canonical_url", 2: "content_hash", 3: "title_similarity", 4: "canonical_event"}
                out[seq] = ("updated" if stage == 1 else "duplicate", names[stage], hit[0])
                break
        else:
            out[seq] = ("new", None, None)
            leaders.append((seq, url, h, ev, title, pub))
    return out


def sample(seed, n):
    rnd = random.Random(seed)
    stems = [
        "Ministry opens tender for coastal rail link number {}",
        "Solar park phase {} wins final approval from regulator",
        "Weekly market brief",
        "Port authority signs framework agreement with builder {}",
        "Short {}",
        "数据中心项目第{}期启动招标公告发布并征集意见稿件材料汇总说明",
    ]
    rows = []
    for i in range(n):
        t = rnd.choice(stems).format(rnd.randint(1, 4))
        if rnd.random() < 0.3:
            k = rnd.randrange(len(t))
            t = t[:k] + rnd.choice("xyz ") + t[k + 1:]
        if rnd.random() < 0.1:
            t = t.upper()
        pub = None if rnd.random() < 0.1 else AS_OF - timedelta(days=rnd.randint(0, 30), hours=rnd.randint(0, 23))
        rows.append((i, f"u{rnd.randint(0, n)}", f"h{rnd.randint(0, n)}", f"e{rnd.randint(0, n // 2)}", t, pub, rnd.random() < 0.7, rnd.random()))
    return rows


@pytest.mark.parametrize("measure,seed,pivots", [("sequence", 1, 64), ("edit", 2, 64), ("sequence", 3, 2)])
def test_matches_sequential_replay(spark, measure, seed, pivots):
    rows = sample(seed, 90)
    df = spark.createDataFrame(rows, DDL)
    got = {
        r.arrival_seq: (r.outcome, r.match_method, r.leader_seq)
        for r in dedup.ingest_cascade(df, AS_OF, measure, pivots=pivots).collect()
    }
    assert got == replay(rows, measure)


def test_replay_in_two_batches_equals_one(spark):
    rows = sample(5, 80)
    df = spark.createDataFrame(rows, DDL)
    whole = {r.arrival_seq: (r.outcome, r.leader_seq) for r in dedup.ingest_cascade(df, AS_OF).collect()}
    first = dedup.ingest_cascade(df.filter("arrival_seq < 40"), AS_OF)
    accepted = first.filter("outcome = 'new'").select(df.columns)
    second = dedup.ingest_cascade(df.filter("arrival_seq >= 40"), AS_OF, existing=accepted)
    parts = {r.arrival_seq: (r.outcome, r.leader_seq) for r in first.unionByName(second).collect()}
    assert parts == whole


def test_one_group_of_copies_stays_whole(spark):
    """A third of the rows share one title and one hash; every copy keeps an outcome."""
    n = 900
    df = spark.range(n).select(
        F.col("id").alias("arrival_seq"),
        F.concat(F.lit("u"), "id").alias("url_key"),
        F.when(F.col("id") % 3 == 0, "copy").otherwise(F.concat(F.lit("h"), "id")).alias("hash_key"),
        F.concat(F.lit("e"), "id").alias("event_key"),
        F.when(F.col("id") % 3 == 0, "the same long headline again and again").otherwise(F.sha2(F.col("id").cast("string"), 256)).alias("title"),
        F.lit(AS_OF).alias("published_at"),
        F.lit(True).alias("eligible"),
    )
    out = dedup.ingest_cascade(df, AS_OF).groupBy("outcome").count().collect()
    assert {r.outcome: r["count"] for r in out} == {"new": 601, "duplicate": 299}


def test_prefix_filter_loses_no_pair(spark):
    rnd = random.Random(9)
    base = ["north harbour expansion contract award notice", "grid upgrade loan agreement", "城市轨道交通三号线延伸段工程可行性研究报告获批"]
    titles = set()
    for _ in range(60):
        t = list(rnd.choice(base))
        for _ in range(rnd.randint(0, 4)):
            k = rnd.randrange(len(t))
            if rnd.random() < 0.5:
                t[k] = rnd.choice("abcdefg")
            elif rnd.random() < 0.5:
                t.insert(k, rnd.choice("abcdefg"))
            else:
                del t[k]
        titles.add("".join(t))
    titles = sorted(titles)
    df = similarity.title_ids(spark.createDataFrame([(t,) for t in titles], "t string"), "t").select("tid", "low")
    names = {r.tid: r.low for r in df.collect()}
    for measure in ("edit", "sequence"):
        got = {(names[r.tid_l], names[r.tid_x]) for r in similarity.similar_to(df, df, measure).collect()}
        fn = edit if measure == "edit" else (lambda a, b: SequenceMatcher(None, a, b).ratio())
        assert got == {(a, b) for a in titles for b in titles if fn(a, b) >= 0.92}
