"""Library-shaped views over the tables of a data folder.

Each view is one SQL text that Spark and DuckDB both accept.  None needs a
window: the line number of an atom is a closed form of its row, and group
statistics are aggregated first and joined back, so that a supplier, customer
or order with a large share of the rows is never gathered in one task.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import checkpoint

ATOMS_FX = """
SELECT l_suppkey AS structure_id,
       ((l_orderkey * 8 + l_linenumber) * 4096 + l_partkey % 4096) * 64
         + CAST(l_quantity AS BIGINT) AS line_no,
       split_part('N,CA,C,O,CB,N5,SG', ',', CAST(l_linenumber AS INT)) AS atom_name,
       split_part('ALA,ARG,ASN,ASP,CYS,GLN,GLU,GLY,HIS,ILE,LEU,LYS,MET,PHE,PRO,SER,THR,TRP,TYR,VAL,HOH,FMN,FAD', ',',
                  CAST((l_partkey % 60) % 23 AS INT) + 1) AS resn,
       l_returnflag AS chain, CAST(l_partkey % 60 AS VARCHAR(8)) AS resi, ' ' AS icode,
       (CAST(l_quantity AS BIGINT) * 100 + CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT) % 100) / CAST(100 AS DOUBLE) AS x,
       (CAST(floor(l_discount * 100 + 0.5) AS BIGINT) * 50 + l_orderkey % 10) / CAST(10 AS DOUBLE) AS y,
       (CAST(floor(l_tax * 100 + 0.5) AS BIGINT) * 50 + l_partkey % 10) / CAST(10 AS DOUBLE) AS z,
       CAST(CAST(floor(l_discount * 100 + 0.5) AS BIGINT) * 5 + 5 AS DOUBLE) AS b_factor,
       substring(split_part('N,CA,C,O,CB,N5,SG', ',', CAST(l_linenumber AS INT)), 1, 1) AS element
FROM lineitem
"""

LINES_FX = """
SELECT structure_id, line_no,
       printf('%-6s%5d %-4s%1s%3s %1s%4s%1s   %8.3f%8s%8.3f%6.2f%6.2f          %2s',
              CASE WHEN resn IN ('HOH', 'FMN', 'FAD') THEN 'HETATM' ELSE 'ATOM' END,
              line_no % 100000, atom_name, ' ', resn, chain, resi, ' ',
              x, CASE WHEN line_no % 97 = 0 THEN 'n/a' ELSE printf('%8.3f', y) END,
              z, CAST(1 AS DOUBLE), b_factor, element) AS value
FROM atoms_fx
UNION ALL
SELECT s_suppkey, CAST(-1 AS BIGINT),
       printf('DBREF  S%03d A    1   600  UNP    P%05d   X_TEST', s_suppkey % 1000, s_suppkey % 100000)
FROM supplier
UNION ALL
SELECT s_suppkey, CAST(-2 AS BIGINT),
       printf('HEADER    %-40s%-12s%4s', 'FLAVOPROTEIN', '01-JAN-00', printf('%04d', (s_suppkey * 7 + 1) % 10000))
FROM supplier WHERE s_suppkey % 3 <> 0
"""

MUTLIST_FX = """
SELECT o_orderkey AS set_id, o_custkey % (SELECT count(*) FROM supplier) AS structure_id, concat(
  split_part('A,N,R', ',', CAST(o_orderkey % 3 AS INT) + 1), ':',
  split_part('A,R,N,D,C,Q,E,G,H,I,L,K,M,F,P,S,T,W,Y,V,H,F,F', ',',
             CAST(((o_orderkey % 60) + CASE WHEN o_orderkey % 11 = 0 THEN 1 ELSE 0 END) % 23 AS INT) + 1),
  CAST(o_orderkey % 60 AS VARCHAR(8)), split_part('V,K,W,F,Y,H,C', ',', CAST(o_orderkey % 7 AS INT) + 1),
  CASE WHEN o_orderkey % 5 = 0 THEN ', Z12R' WHEN o_orderkey % 5 = 1 THEN ' A0V'
       WHEN o_orderkey % 5 = 2 THEN ',r:g7ak,12K' ELSE '' END) AS raw
FROM orders
"""

_ORDER_CENTS = """
SELECT o_orderkey AS pdb_id, o_custkey AS uniprot_id,
       CASE WHEN o_orderstatus = 'F' THEN 'FAD' ELSE 'FMN' END AS cofactor,
       CAST(round(o_totalprice * 100) AS BIGINT) AS cents,
       concat(CAST(o_custkey % 50 AS VARCHAR(8)), o_orderpriority) AS grp
FROM orders
"""

# Means come from exact integer sums, so both engines give the same double.  The
# odd divisor keeps values away from decimal ties, where engines round apart.
EVAL_FX = f"""
SELECT o.pdb_id, o.uniprot_id, o.cofactor, o.cents / CAST(100003 AS DOUBLE) AS em,
       l.iso, l.hb_cap, l.flex,
       CAST(u.total AS DOUBLE) / CAST(u.n AS DOUBLE) / 100003 AS gpr_pred_raw,
       CAST(u.high - u.low AS DOUBLE) / 200006 AS gpr_sigma,
       CAST(g.total AS DOUBLE) / CAST(g.n AS DOUBLE) / 100003 AS pred_q,
       l.st_gap, l.n5_spin, l.n5_spin * 20 AS hfcc_primary
FROM ({_ORDER_CENTS}) o
JOIN (SELECT l_orderkey,
             CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS iso,
             CAST(count(*) AS DOUBLE) AS hb_cap,
             1 + CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS DOUBLE) / CAST(count(*) AS DOUBLE) / 20 AS flex,
             CAST(sum(CAST(round(l_tax * 100) AS BIGINT)) AS DOUBLE) / CAST(count(*) AS DOUBLE) / 400 AS st_gap,
             CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS DOUBLE) / CAST(count(*) AS DOUBLE) / 10 AS n5_spin
      FROM lineitem GROUP BY l_orderkey) l ON l.l_orderkey = o.pdb_id
JOIN (SELECT uniprot_id, sum(cents) AS total, count(*) AS n, max(cents) AS high, min(cents) AS low
      FROM ({_ORDER_CENTS}) a GROUP BY uniprot_id) u ON u.uniprot_id = o.uniprot_id
JOIN (SELECT grp, sum(cents) AS total, count(*) AS n
      FROM ({_ORDER_CENTS}) b GROUP BY grp) g ON g.grp = o.grp
"""

LOG_FX = """
SELECT event_id AS seq, concat('U', CAST(user_id AS VARCHAR(12))) AS profile_id,
       event_type AS label, value
FROM events
"""

# DuckDB text; Spark uses posexplode (see Tables.curves).
CURVE_FX = """
SELECT vec_id AS curve_id, unnest(range(len(embedding))) AS theta,
       CAST(unnest(embedding) AS DOUBLE) AS phi
FROM embeddings
"""

FIXTURES = {
    "atoms_fx": ATOMS_FX, "lines_fx": LINES_FX, "mutlist_fx": MUTLIST_FX,
    "eval_fx": EVAL_FX, "log_fx": LOG_FX, "curve_fx": CURVE_FX,
}
class Tables:
    """The data folder as DataFrames, fixtures included."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def _view(self, sql: str, **frames: DataFrame) -> DataFrame:
        for name in frames:
            sql = re.sub(rf"\b{name}\b", "{" + name + "}", sql)
        return self.spark.sql(sql, **frames)

    @cached_property
    def atoms(self) -> DataFrame:
        return self._view(ATOMS_FX, lineitem=self.table("lineitem"))

    @cached_property
    def lines(self) -> DataFrame:
        text = self._view(LINES_FX, atoms_fx=self.atoms,
                          supplier=self.table("supplier"))
        # Text that comes from a file is read once; rendered text would be
        # rendered again for every predicate pushed through it.  A generator
        # is a barrier to that, and needs no shuffle.
        return text.select("structure_id", "line_no",
                           F.explode(F.array("value")).alias("value"))

    @cached_property
    def mutlists(self) -> DataFrame:
        return self._view(MUTLIST_FX, orders=self.table("orders"), supplier=self.table("supplier"))

    @cached_property
    def evals(self) -> DataFrame:
        return self._view(EVAL_FX, orders=self.table("orders"),
                          lineitem=self.table("lineitem"))

    @cached_property
    def evals_once(self) -> DataFrame:
        """The evaluation rows after one reading: statistics and rows need them again."""
        return checkpoint(self.evals)

    @cached_property
    def log(self) -> DataFrame:
        return self._view(LOG_FX, events=self.table("events"))

    @cached_property
    def curves(self) -> DataFrame:
        return self.table("embeddings").selectExpr(
            "vec_id AS curve_id", "posexplode(embedding) AS (theta, v)"
        ).selectExpr("curve_id", "CAST(theta AS BIGINT) AS theta",
                     "CAST(v AS DOUBLE) AS phi")
