"""Keys for nearest neighbours (C2), SMOTE (F10) and the k-NN vote."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvid.keys import key
from corvid.keys.splits_sql import split_sql
from corvid.operators import neighbors as N
from corvid.operators import prep
from corvid.sources import views
from corvid.sources.tables import load

_EMB_CTE = ", emb AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings)\n"


def _emb(spark, sf):
    return load(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


@key("knn_exact", _EMB_CTE + """SELECT qid, nid, dist, rank FROM (
  SELECT q.id AS qid, c.id AS nid, round(list_distance(q.v, c.v), 4) AS dist,
         row_number() OVER (PARTITION BY q.id ORDER BY list_distance(q.v, c.v), c.id) AS rank
  FROM emb q JOIN emb c ON q.id <> c.id) t WHERE rank <= 5""")
def knn_exact(spark, sf):
    e = _emb(spark, sf)
    nn = N.knn_exact(e, e, "embedding", 5)
    return nn.select("qid", "nid", F.round("dist", 4).alias("dist"), "rank")


def _lsh_sql(dim: int = 64) -> str:
    """The exact answer of the bucketed search: rows that share a bucket in a table."""
    codes = []
    for t, bits in enumerate(N.lsh_planes(dim)):
        terms = " + ".join(f"CASE WHEN list_dot_product(v, [{', '.join(repr(float(x)) for x in p)}]::DOUBLE[]) >= 0 "
                           f"THEN {1 << b} ELSE 0 END" for b, p in enumerate(bits))
        codes.append(f"SELECT id, v, {t} AS t, {terms} AS code FROM emb")
    return ", hashed AS MATERIALIZED (" + " UNION ALL ".join(codes) + """)
, pairs AS (SELECT DISTINCT q.id AS qid, c.id AS nid, list_distance(q.v, c.v) AS d
            FROM hashed q JOIN hashed c ON q.t = c.t AND q.code = c.code AND q.id <> c.id)
SELECT qid, nid, round(d, 4) AS dist, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d, nid) AS rank FROM pairs) r WHERE rank <= 5"""


@key("knn_lsh", _EMB_CTE + _lsh_sql())
def knn_lsh(spark, sf):
    return N.knn_lsh(_emb(spark, sf), "embedding", 5).select("qid", "nid", F.round("dist", 4).alias("dist"), "rank")


@key("knn_classify", _EMB_CTE + split_sql("emb", "sp", 0.2, 42) + """
, nn AS (SELECT q.id AS qid, c.label AS lab,
                row_number() OVER (PARTITION BY q.id ORDER BY list_distance(q.v, c.v), c.id) AS r
         FROM sp q JOIN sp c ON q.split = 'test' AND c.split = 'train')
, votes AS (SELECT qid, lab, count(*) AS n FROM nn WHERE r <= 5 GROUP BY qid, lab)
SELECT qid AS id, lab AS prediction, n / 5.0 AS share FROM (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY n DESC, lab) AS rr FROM votes) z WHERE rr = 1""")
def knn_classify(spark, sf):
    sp = prep.stratified_split(_emb(spark, sf), "label", "id", 0.2, 42).cache()
    return N.knn_classify(sp.where(F.col("split") == "train"), sp.where(F.col("split") == "test"),
                          "embedding", 5)


_IF = views.IMB_FEATURES
_LIST = lambda a: "[" + ", ".join(f"{a}.{c}" for c in _IF) + "]"


def _u(tag):
    return f"(('0x' || substr(md5('42|{tag}|' || CAST(draw AS VARCHAR)), 1, 8))::BIGINT)"


@key("smote", f"""
, cnt AS (SELECT label, count(*) AS n FROM imb GROUP BY label)
, mi AS (SELECT label AS ml, n AS m FROM cnt ORDER BY n, label LIMIT 1)
, need AS (SELECT max(n) - (SELECT m FROM mi) AS d FROM cnt)
, rk AS (SELECT *, row_number() OVER (ORDER BY md5('42|' || CAST(id AS VARCHAR)), id) AS r
         FROM imb WHERE label = (SELECT ml FROM mi))
, nn AS (SELECT base_id, nbr_id, nr FROM (
          SELECT q.id AS base_id, c.id AS nbr_id,
                 row_number() OVER (PARTITION BY q.id ORDER BY list_distance({_LIST('q')}, {_LIST('c')}), c.id) AS nr
          FROM rk q JOIN rk c ON q.id <> c.id) t WHERE nr <= 5)
, dr AS (SELECT unnest(generate_series(1, (SELECT d FROM need))) AS draw)
, dd AS (SELECT draw, {_u('b')} % (SELECT m FROM mi) + 1 AS br, {_u('n')} % 5 + 1 AS nrk,
                CAST({_u('u')} AS DOUBLE) / 4294967296.0 AS u FROM dr)
SELECT dd.draw, b.id AS base_id, nb.id AS nbr_id, """ + ", ".join(
    f"round(b.{c} + dd.u * (nb.{c} - b.{c}), 4) AS {c}" for c in _IF) + """, b.label
FROM dd JOIN rk b ON b.r = dd.br JOIN nn ON nn.base_id = b.id AND nn.nr = dd.nrk JOIN rk nb ON nb.id = nn.nbr_id""")
def smote(spark, sf):
    syn = N.smote(views.imb(spark, sf), _IF, "label", "id", 5, 42, return_synthetic_only=True)
    return syn.select("draw", "base_id", "nbr_id", *[F.round(c, 4).alias(c) for c in _IF], "label")
