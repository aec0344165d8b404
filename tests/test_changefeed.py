import random

from heddle.streaming.changefeed import apply_journal

from .conftest import rows

JOURNAL = (
    "store_id string, generation bigint, upserted_documents array<struct<document_id:string,document_hash:string,chunk_ids:array<string>,metadata:map<string,string>>>,"
    "deleted_document_ids array<string>, received_at bigint, document_id string"
)


def brute(feed):
    kept = {}
    for store, gen, ups, dels, at in feed:
        if store is not None and gen is not None and ((store, gen) not in kept or (at or -1) > kept[store, gen][0]):
            kept[store, gen] = (at or -1, ups, dels)
    state = {}
    for (store, gen), (_, ups, dels) in sorted(kept.items()):
        for d in dels or []:
            state.pop((store, d), None)
        for u in ups or []:
            if u is not None and u[0] is not None:
                state[store, u[0]] = u[1]
    return sorted(((s, d, h) for (s, d), h in state.items()), key=repr)


def feed_of(seed, n=120):
    rng = random.Random(seed)
    feed = []
    for i in range(n):
        ups = rng.choice([None, [], [(f"d{rng.randrange(6)}", rng.choice(["h1", "h2", None]), None, None) for _ in range(rng.randrange(1, 5))]])
        dels = rng.choice([None, [], [f"d{rng.randrange(8)}" for _ in range(2)], [None]])
        feed.append(("hot" if i % 3 else rng.choice(["a", "b", None]), rng.choice([None, *range(25)]), ups, dels, i))
    feed += feed[:15]
    rng.shuffle(feed)
    return feed


def write(spark, path, feed, mode="overwrite"):
    spark.createDataFrame([(*f, "clash") for f in feed], JOURNAL).coalesce(1).write.mode(mode).parquet(path)


def test_final_state(spark, tmp_path):
    feed = feed_of(1)
    write(spark, f"{tmp_path}/j", feed)
    assert rows(apply_journal(spark, f"{tmp_path}/j")) == brute(feed)
    assert rows(apply_journal(spark, f"{tmp_path}/j", max_files_per_trigger=1)) == brute(feed)


def test_resumes_with_later_files(spark, tmp_path):
    """Files that arrive later, redeliveries of old generations included, in small batches."""
    feed = feed_of(2)
    write(spark, f"{tmp_path}/j", feed[:60])
    assert rows(apply_journal(spark, f"{tmp_path}/j", f"{tmp_path}/work")) == brute(feed[:60])
    for part in (feed[60:100], feed[100:]):
        write(spark, f"{tmp_path}/j", part, "append")
    assert rows(apply_journal(spark, f"{tmp_path}/j", f"{tmp_path}/work", 1)) == brute(feed)


def test_single_file_and_empty_feed(spark, tmp_path):
    write(spark, f"{tmp_path}/one", feed_of(3))
    part = next((tmp_path / "one").glob("part-*.parquet"))
    part.rename(tmp_path / "journal.parquet")
    assert rows(apply_journal(spark, f"{tmp_path}/journal.parquet")) == brute(feed_of(3))
    write(spark, f"{tmp_path}/none", [])
    assert apply_journal(spark, f"{tmp_path}/none").count() == 0


def test_only_replaced_generations_start_it_afresh(spark, tmp_path):
    """New generations, late ones among them, resume both streams; a redelivery with other content starts the second anew."""
    up = lambda *ids: [(i, f"h-{i}", None, None) for i in ids]
    parts = [
        [("s", 1, up("a", "b"), None, 10), ("s", 5, up("c"), ["a"], 11)],
        [("s", 3, up("a", "d"), None, 12), ("s", 1, up("a", "b"), None, 10)],  # late, and the same again
        [("s", 5, up("e"), None, 20)],  # takes back c and the delete of a
    ]
    feed = []
    for part, rounds in zip(parts, (1, 1, 2)):
        feed += part
        write(spark, f"{tmp_path}/j", part, "append")
        assert rows(apply_journal(spark, f"{tmp_path}/j", f"{tmp_path}/work")) == brute(feed)
        assert len(list((tmp_path / "work" / "applied").glob("round=*"))) == rounds


def test_streams_leave_the_session_alone(spark, tmp_path):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    write(spark, f"{tmp_path}/j", feed_of(4))
    apply_journal(spark, f"{tmp_path}/j")
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before
