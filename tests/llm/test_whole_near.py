"""Near duplicates where doc_ids are null or repeat."""

from test_ops import docs, extended, prose

from matchstats.llm import near_dedup


def test_rows_are_linked_by_text_alone(spark):
    a, z, own = prose(201, 80), prose(202, 80), prose(203, 80)
    texts = [(4, a), (None, a + " tail"), (9, z), (None, z + " tail"), (5, own), (5, a + " end"), (None, prose(204, 80)), ((1 << 63) - 1, prose(205, 80)), (6, ""), (6, "")]
    d = extended(docs(spark, [t for _, t in texts], ids=[i for i, _ in texts]))
    key = lambda r: str((r.doc_id, r.component_id, r.kept))
    got = sorted(key(r) for r in near_dedup.near_duplicates(d).collect())
    top = (1 << 63) - 1
    assert got == sorted(map(str, [(4, 4, True), (None, 4, False), (9, 9, True), (None, 9, False), (5, 5, True), (5, 4, False), (None, None, True), (top, top, True), (6, 6, True), (6, 6, True)]))
    kept = near_dedup.kept_documents(d)
    assert kept.columns == d.columns
    gone = {(None, a + " tail"), (None, z + " tail"), (5, a + " end")}
    assert sorted(map(str, ((r.doc_id, r.text) for r in kept.collect()))) == sorted(str(x) for x in texts if x not in gone)


def test_null_ids_alone_keep_one(spark):
    a = prose(206, 80)
    d = docs(spark, [a, a, a + " tail", a + " end", prose(207, 80)], ids=[None] * 5)
    assert {r.component_id for r in near_dedup.near_duplicates(d).collect()} == {None}
    assert near_dedup.kept_documents(d).count() == 2
