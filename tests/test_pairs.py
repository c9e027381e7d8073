"""Communities and clusters refined without a table of their pairs."""

import random

from pyspark.sql import functions as F

from weftline import runtime
from weftline.config import Settings
from weftline.operators import components, decisions, numbering, similarity
from weftline.plans import digest


def test_communities_without_pairs_are_those_of_the_pairs(spark):
    # Word counts, so that many cosines are equal to the threshold (1/2 as 2/4 of vectors with four words); copies, a null and an empty vector.
    rng = random.Random(5)
    rows = [(i, [float(x in words) for x in range(16)]) for i in range(300) for words in [rng.sample(range(16), 4)]]
    rows += [(1000 + i, v) for i, v in rows[:20]] + [(2000, [0.0] * 16), (2001, None)]
    vectors = runtime.materialize(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3), "vectors")
    want = {(r.id, r.center, r.cluster_pos) for r in similarity.communities(runtime.materialize(similarity.cosine_pairs(vectors, 0.5 - 1e-9), "pairs")).collect()}
    got = similarity.vector_communities(vectors, 0.5, block_values=16 * 70).collect()
    assert {(r.id, r.center, r.cluster_pos) for r in got} == want and len(got) == 320
    assert len({(r.cluster_pos, r.member_pos) for r in got}) == 320


def test_a_rule_where_pairs_are_made_gives_the_clusters_of_the_batches(spark):
    # Clusters of one, a chain longer than a chunk, and pairs alike by a rule that leaves several components.
    sizes = [1, 2, 7, 40, 90]
    clusters = runtime.materialize(spark.createDataFrame([(c, m) for c, n in enumerate(sizes) for m in range(n)], "cluster_pos long, member_pos int"), "clusters")
    gap = F.col("j") - F.col("i")
    rule = F.when(F.when(F.col("cluster_pos") == 4, gap == 1).otherwise(((F.col("i") * 7 + F.col("j") * 13) % 11 == 0) | (gap == 17)), "same_story")
    provider = decisions.RuleProvider({"relationship": rule})
    pairs = decisions.number(components.pairs_in_cluster(clusters), ["cluster_pos", "i", "j"], 20)
    decided = runtime.materialize(decisions.relationships(pairs, provider.decide(pairs)), "decided")
    want = {tuple(r) for r in components.refine(clusters, decided).collect()}
    got, same = components.refine_by_rule(clusters, provider.expression(components.pairs_in_cluster(clusters), "relationship") == "same_story", chunk_rows=16)
    assert {tuple(r) for r in got.collect()} == want and len(want) == sum(sizes)
    assert same == decided.where("relationship = 'same_story'").count() > 0


def test_rules_on_batches_and_calls_that_fail_are_not_applied_in_place(spark):
    pairs = spark.createDataFrame([(1, 0, 1)], "cluster_pos long, i int, j int")
    same = F.when(F.col("i") + F.col("j") == 1, "same_story")
    assert decisions.RuleProvider({"relationship": same}).expression(pairs, "relationship") is not None
    assert decisions.RuleProvider({"relationship": same}, ok=F.col("batch_no") > 0).expression(pairs, "relationship") is None
    assert decisions.RuleProvider({"relationship": F.when(F.col("pos") > 0, "same_story")}).expression(pairs, "relationship") is None


def test_a_digest_writes_no_table_of_pairs(spark, monkeypatch):
    wrote, write = [], runtime.materialize

    def counted(df, tag, path=None):
        out = write(df, tag, path)
        wrote.append(runtime.rows_of(out))
        return out

    for module in (digest, similarity, components, decisions, numbering):
        if hasattr(module, "materialize"):
            monkeypatch.setattr(module, "materialize", counted)
    records = spark.range(400).select(F.col("id").alias("rec_pos"), F.concat(F.lit("the council sold the harbour to builders "), F.col("id").cast("string")).alias("body"))
    same = decisions.RuleProvider({"relationship": F.when((F.col("i") + F.col("j")) % 2 == 1, "same_story")})
    refined = digest.refine(counted(digest.cluster(records, Settings()), "clusters"), same, Settings())
    assert refined.select("cluster_pos").distinct().count() == 1 and refined.count() == 400
    assert max(wrote) <= 2 * 400
