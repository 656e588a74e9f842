"""Pages by seek: the pages that an offset gives, from few parts wherever they lie."""

import random

import pytest
from pyspark.sql import functions as F
from test_rollup import DAY, START
from test_sources import usage, usage_row

from meterglass.operators import reports
from meterglass.streaming import archive


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Two rounds over two years; many records share a time, and a message's identifier is used by several hosts."""
    rng, folder = random.Random(8), str(tmp_path_factory.mktemp("paged"))
    rows = [usage_row(message_id=f"m{rng.randrange(300)}", source=rng.choice("ab"), host_id=rng.choice("hi"), time_created_utc=START + rng.randrange(240) * 3 * DAY, source_time_updated=i, tok_input=i) for i in range(900)]
    archive.publish(usage(spark, *rows[:600]), folder, 0)
    archive.publish(usage(spark, *rows[600:]), folder, 1)
    return folder


def keys(rows):
    return [(r.time_created_utc, r.message_id, r.host_id, r.source) for r in rows]


def paged(spark, folder, limit, **options):
    out, after = [], None
    while rows := archive.page(spark, folder, limit, after, **options).collect():
        assert len(rows) <= limit
        out += rows
        after = keys(rows)[-1]
    return out


def ordered(rows):
    return sorted(keys(rows), key=lambda k: (-k[0], *k[1:]))


def test_pages_are_all_records_in_order(spark, folder):
    held = archive.archive(spark, folder).collect()
    assert keys(paged(spark, folder, 97)) == ordered(held)
    some = [r for r in held if r.tok_input % 50 == 0]  # few, so that parts are added until a page is full
    assert keys(paged(spark, folder, 5, where=F.col("tok_input") % 50 == 0)) == ordered(some)
    assert keys(paged(spark, folder, 150, sources=["b"], as_of=0)) == ordered(archive.archive(spark, folder, sources=["b"], as_of=0).collect())


def test_a_page_opens_few_parts(spark, folder):
    have = archive.parts(spark, folder).collect()
    everything = ordered(archive.archive(spark, folder).collect())
    for at in (0, len(everything) // 2, len(everything) - 30):
        after = everything[at]
        paths, low = archive.reaching(have, after[0], 10)
        # what is opened spans a few of the 24 months, each of two sources and eight slots
        assert len(paths) <= 4 * 2 * archive.SLOTS < len(have) / 3
        assert low is None or sum(low <= k[0] < after[0] for k in everything) >= 10
        assert keys(archive.page(spark, folder, 10, after).collect()) == everything[at + 1 : at + 11]


def test_edges(spark, tmp_path, folder):
    assert archive.page(spark, str(tmp_path / "nothing"), 10).count() == 0
    with pytest.raises(ValueError, match="positive"):
        archive.page(spark, folder, 0)
    assert archive.page(spark, folder, 100_000).count() == reports.MOST_PER_PAGE
    assert archive.page(spark, folder, 10, (START - 1, "", "", "")).count() == 0
    last = ordered(archive.archive(spark, folder).collect())[-1]
    assert archive.page(spark, folder, 10, last).count() == 0
