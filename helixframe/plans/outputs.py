"""Queries of complete output sets, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixframe.operators import alignments as A
from helixframe.operators import cells as C
from helixframe.operators import genes as G
from helixframe.operators import junctions as J
from helixframe.operators import molecules as M
from helixframe.operators.ranking import global_rank
from helixframe.operators.storage import scratch
from helixframe.plans import adapters as V
from helixframe.plans.adapters import with_views
from helixframe.plans.registry import query
from helixframe.sinks import sets
from helixframe.sources import split


@query(with_views("scored") + """, r as (select *, row_number() over (partition by read_id order by score desc, n_junction, chr, "start", is_reverse) as hit,
  count(*) over (partition by read_id) as k from scored)
, h as (select distinct chr from scored)
, lines as (select 0 as k0, cast(0 as bigint) as c, cast(0 as bigint) as s, cast(0 as bigint) as read_id, cast(0 as bigint) as hit, '@HD' || chr(9) || 'VN:1.4' || chr(9) || 'SO:coordinate' as line
  union all select 1, chr, 0, 0, 0, '@SQ' || chr(9) || 'SN:chr' || chr || chr(9) || 'LN:100000000' from h
  union all select 2, r.chr, "start", read_id, hit, read_id || chr(9) || (case when is_reverse then 16 else 0 end + case when hit > 1 then 256 else 0 end) || chr(9) || 'chr' || r.chr
  || chr(9) || ("start" + 1) || chr(9) || case when k = 1 then 255 when k = 2 then 3 when k <= 4 then 1 else 0 end || chr(9) || '100M' || chr(9) || '*' || chr(9) || '0'
  || chr(9) || '0' || chr(9) || '*' || chr(9) || '*' || chr(9) || 'NH:i:' || k || chr(9) || 'HI:i:' || hit || chr(9) || 'AS:i:' || score || chr(9) || 'nM:i:' || n_mismatch from r)
select row_number() over (order by k0, c, s, read_id, hit) as line_no, line from lines""")
def sam_sorted(spark, d):
    """Alignments written in coordinate order below their header, and the file's lines."""
    hits = A.ranked(A.drop_many_loci(V.scored(spark, d), 1000)).withColumns({
        "chr_name": F.concat(F.lit("chr"), F.col("chr").cast("string")), "cigar": F.concat(F.col("read_len").cast("string"), F.lit("M")),
        "seq": F.lit(None).cast("string"), "qual": F.lit(None).cast("string"),
    })
    chromosomes = V.table(spark, d, "lineitem").select((F.col("l_suppkey") % 5).alias("chr")).distinct()
    names = chromosomes.select("chr", F.concat(F.lit("chr"), F.col("chr").cast("string")).alias("chr_name"), F.lit(100_000_000).alias("length"))
    path = scratch(spark, "sam")
    sets.sam_set(hits, names, path, compression="gzip")
    return split.numbered_lines(spark, path)


REPORT = """with r as (select l_linenumber % 6 as k, 100 as len, cast(floor(l_quantity) as bigint) as q, l_partkey % 3 as mm, l_suppkey % 2 as i, l_partkey % 4 as d, l_suppkey % 5 as why, l_partkey % 50 = 0 as chim, l_partkey % 7 as motif,
  l_suppkey % 3 = 0 as ann from lineitem)
, c as (select count(*) as reads, sum(len) as bases, count(*) filter (k = 1) as u, count(*) filter (k in (2, 3)) as m, count(*) filter (k > 3) as many,
  sum(q) filter (k = 1) as mapped, sum(mm) filter (k = 1) as mm, sum(i) filter (k = 1) as i, sum(2 * i) filter (k = 1) as ib, sum(d) filter (k = 1) as d, sum(3 * d) filter (k = 1) as db, count(*) filter (chim) as chim,
  count(*) filter (k = 0 and why = 0) as w0, count(*) filter (k = 0 and why in (1, 2)) as w1, count(*) filter (k = 0 and why > 2) as w2,
  count(*) filter (k = 1) as sp, count(*) filter (k = 1 and ann) as ann, count(*) filter (k = 1 and motif in (1, 2)) as gt, count(*) filter (k = 1 and motif in (3, 4)) as gc,
  count(*) filter (k = 1 and motif in (5, 6)) as atac, count(*) filter (k = 1 and motif = 0) as non from r)
, l as (select unnest([
  ('Number of input reads', reads::varchar), ('Average input read length', (bases // reads)::varchar), ('UNIQUE READS:', null), ('Uniquely mapped reads number', u::varchar),
  ('Uniquely mapped reads %', printf('%.2f%%', 100.0::double * u / reads)), ('Average mapped length', printf('%.2f', mapped::double / u)), ('Number of splices: Total', sp::varchar),
  ('Number of splices: Annotated (sjdb)', ann::varchar), ('Number of splices: GT/AG', gt::varchar), ('Number of splices: GC/AG', gc::varchar), ('Number of splices: AT/AC', atac::varchar),
  ('Number of splices: Non-canonical', non::varchar), ('Mismatch rate per base, %', printf('%.2f%%', 100.0::double * mm / mapped)), ('Deletion rate per base', printf('%.2f%%', 100.0::double * db / mapped)),
  ('Deletion average length', printf('%.2f', db::double / d)), ('Insertion rate per base', printf('%.2f%%', 100.0::double * ib / mapped)), ('Insertion average length', printf('%.2f', ib::double / i)),
  ('MULTI-MAPPING READS:', null), ('Number of reads mapped to multiple loci', m::varchar), ('% of reads mapped to multiple loci', printf('%.2f%%', 100.0::double * m / reads)),
  ('Number of reads mapped to too many loci', many::varchar), ('% of reads mapped to too many loci', printf('%.2f%%', 100.0::double * many / reads)), ('UNMAPPED READS:', null),
  ('Number of reads unmapped: too many mismatches', w0::varchar), ('% of reads unmapped: too many mismatches', printf('%.2f%%', 100.0::double * w0 / reads)),
  ('Number of reads unmapped: too short', w1::varchar), ('% of reads unmapped: too short', printf('%.2f%%', 100.0::double * w1 / reads)),
  ('Number of reads unmapped: other', w2::varchar), ('% of reads unmapped: other', printf('%.2f%%', 100.0::double * w2 / reads)), ('CHIMERIC READS:', null),
  ('Number of chimeric reads', chim::varchar), ('% of chimeric reads', printf('%.2f%%', 100.0::double * chim / reads))]) as x, unnest(range(32)) as line_at from c)
select cast(line_at as integer) as "at", case when x[2] is null then lpad(x[1], 49, ' ') else lpad(x[1], 47, ' ') || ' |' || chr(9) || x[2] end as value from l"""


@query(REPORT)
def report_text(spark, d):
    """The final report's lines over the line items as reads, those of one place with one intron each."""
    c = F.col
    x = V.table(spark, d, "lineitem")
    why = F.when(c("l_suppkey") % 5 == 0, "too_many_mismatches").when(c("l_suppkey") % 5 < 3, "too_short").otherwise("other")
    reads = x.select((c("l_linenumber") % 6).alias("n_loci"), F.lit(100).alias("read_len"), F.floor("l_quantity").alias("mapped_len"), (c("l_partkey") % 3).alias("n_mismatch"), (c("l_suppkey") % 2).alias("ins"),
                     (c("l_suppkey") % 2 * 2).alias("ins_bases"), (c("l_partkey") % 4).alias("dels"), (c("l_partkey") % 4 * 3).alias("del_bases"), (c("l_partkey") % 50 == 0).alias("chimeric"), why.alias("reason"))
    cut = x.filter("l_linenumber % 6 = 1").select((c("l_partkey") % 7).alias("motif"), (c("l_suppkey") % 3 == 0).alias("annotated"))
    return sets.report_lines(sets.alignment_counters(reads, cut, 3))


SUMMARY = with_views("dense") + """, m as (select cb, umi, gene, count(*) as reads from dense group by cb, umi, gene)
, c as (select cb, gene, count(*) as value from m group by cb, gene)
, s as (select cb, n_reads, n_umis, n_genes from (select cb, sum(reads) as n_reads from m group by cb) join (select cb, sum(value) as n_umis, count(*) as n_genes from c group by cb) using (cb))
, i as (select * from s where n_umis >= 50)
, t as (select count(*) as reads, count(*) filter (l_partkey % 10 <> 0) as valid, count(*) filter (l_linenumber = 1) as u, count(*) filter (l_linenumber = 2) as mm, count(*) filter (l_linenumber = 1 and l_partkey % 10 <> 0) as f from lineitem)
, e as (select sum(n_reads) as r, sum(n_umis) as u from s)
, o as (select count(*) as n, sum(n_reads) as r, sum(n_umis) as u, sum(n_genes) as g, median(n_reads) as mr, median(n_umis) as mu, median(n_genes) as mg from i)
, l as (select unnest(['Number of Reads,' || t.reads, 'Reads With Valid Barcodes,' || printf('%.6f', valid::double / t.reads), 'Sequencing Saturation,' || printf('%.6f', 1 - e.u::double / e.r),
  'Reads Mapped to Genome: Unique+Multiple,' || printf('%.6f', (t.u + mm)::double / t.reads), 'Reads Mapped to Genome: Unique,' || printf('%.6f', t.u::double / t.reads),
  'Reads Mapped to Gene: Unique Gene,' || printf('%.6f', f::double / t.reads), 'Estimated Number of Cells,' || n, 'Unique Reads in Cells Mapped to Gene,' || cast(o.r as bigint),
  'Fraction of Unique Reads in Cells,' || printf('%.6f', o.r::double / e.r), 'Mean Reads per Cell,' || cast(floor(o.r / n) as bigint), 'Median Reads per Cell,' || cast(floor(mr) as bigint), 'UMIs in Cells,' || cast(o.u as bigint),
  'Mean UMI per Cell,' || cast(floor(o.u / n) as bigint), 'Median UMI per Cell,' || cast(floor(mu) as bigint), 'Mean Gene per Cell,' || cast(floor(g / n) as bigint), 'Median Gene per Cell,' || cast(floor(mg) as bigint),
  'Total Gene Detected,' || (select count(distinct gene) from c where cb in (select cb from i))]) as value, unnest(range(17)) as line_at from t, e, o)
select cast(line_at as integer) as "at", value from l"""


@query(SUMMARY)
def summary_text(spark, d):
    """The seventeen lines of a run's summary; cells are barcodes of at least 50 molecules."""
    mols = M.molecules(V.dense(spark, d))
    counts = M.count_exact(mols)
    cells = M.cell_stats(mols, counts)
    called = cells.filter("n_umis >= 50")
    n = lambda test: F.sum(F.expr(test).cast("long"))
    totals = V.table(spark, d, "lineitem").agg(F.count(F.lit(1)).alias("reads"), n("l_partkey % 10 <> 0").alias("valid_barcodes"), n("l_linenumber = 1").alias("unique_reads"), n("l_linenumber = 2").alias("multi_reads"),
                                               n("l_linenumber = 1 and l_partkey % 10 <> 0").alias("feature_reads"))
    return sets.summary_lines(cells, called, totals, C.summary(cells, counts, called).select("genes_detected"))


#: One step of correction among tags of three bases: m is (cb, gene, umi, reads).
NEAREST = """, up as (select a.cb, a.gene, a.umi, b.umi as target from m a join m b on a.cb = b.cb and a.gene = b.gene and bit_count((xor(a.umi, b.umi) | (xor(a.umi, b.umi) >> 1)) & 21) = 1
  where (b.reads, b.umi) > (a.reads, a.umi) qualify row_number() over (partition by a.cb, a.gene, a.umi order by b.reads desc, b.umi desc) = 1)
, v as (select m.cb, m.gene, count(distinct coalesce(target, m.umi)) as value from m left join up on m.cb = up.cb and m.gene = up.gene and m.umi = up.umi group by 1, 2)"""


def _states(spark, d):
    x = V.table(spark, d, "lineitem")
    return x.select((F.col("l_suppkey") % 40).alias("cb"), (F.col("l_orderkey") % 8).alias("gene"), (F.col("l_partkey") % 64).alias("umi"), (F.col("l_linenumber") % 5 == 0).cast("int").alias("junctions"),
                    (F.col("l_quantity") > 5).alias("exonic"))


STATES = """with s as (select l_suppkey % 40 as cb, l_orderkey % 8 as gene, l_partkey % 64 as umi, max(case when l_linenumber % 5 = 0 then 1 when l_quantity > 5 then 0 else 2 end) as s, count(*) as reads from lineitem group by 1, 2, 3)
, m as (select cb, gene * 3 + {0} as gene, umi, reads from s)""" + NEAREST + """
select cb, gene // 3 as gene, cast(coalesce(sum(value) filter (gene % 3 = 1), 0) as bigint) as spliced, cast(coalesce(sum(value) filter (gene % 3 = 2), 0) as bigint) as unspliced,
  cast(coalesce(sum(value) filter (gene % 3 = 0), 0) as bigint) as ambiguous from v group by 1, 2"""


@query(STATES.format("s"))
def splice_states_1mm(spark, d):
    """Molecules by splice state, tags collapsed within each state."""
    return G.splice_states(_states(spark, d), 3, method="1mm_cr")


@query(STATES.format("greatest(s, 1)"))
def splice_states_folded(spark, d):
    """Ambiguous molecules counted as spliced before tags are collapsed."""
    return G.splice_states(_states(spark, d), 3, method="1mm_cr", keep_ambiguous=False)


@query(with_views("obs") + """, r as (select chr, "start", "end", row_number() over (order by chr, "start", "end") - 1 as sj from (select distinct chr, "start", "end" from obs))
, m as (select obs.read_id % 50 as cb, sj as gene, obs.read_id % 64 as umi, count(*) as reads from obs join r on obs.chr = r.chr and obs."start" = r."start" and obs."end" = r."end" group by 1, 2, 3)"""
       + NEAREST + " select cb, gene as sj, value from v")
def sj_matrix_1mm(spark, d):
    """Junctions by cell, tags of one junction collapsed."""
    obs = V.junction_obs(spark, d)
    rows = global_rank(obs.select("chr", "start", "end").distinct(), [F.col("chr"), F.col("start"), F.col("end")], "sj").withColumn("sj", F.col("sj") - 1)
    return J.matrix_by(obs.select((F.col("read_id") % 50).alias("cb"), (F.col("read_id") % 64).alias("umi"), "chr", "start", "end"), rows, 3, "1mm_cr")
