"""Registered queries of the sequencing operators and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixframe.functions import sequence as S
from helixframe.operators import alignments as A
from helixframe.operators import barcodes as B
from helixframe.operators import cells as C
from helixframe.operators import genes as G
from helixframe.operators import intervals as I
from helixframe.operators import junctions as J
from helixframe.operators import molecules as M
from helixframe.operators.ranking import adjust_p
from helixframe.plans import adapters as V
from helixframe.plans.adapters import with_views
from helixframe.plans.registry import ORACLE_SQL, QUERIES, query  # noqa: F401

MOLS = ", m as (select cb, umi, gene, cast(sum(n) as bigint) as reads from sparse group by cb, umi, gene)"
DMOLS = ", m as (select cb, umi, gene, count(*) as reads from dense group by cb, umi, gene)"
EDGES = """, e as (select a.cb, a.gene, a.umi, a.reads, b.umi as other, b.reads as other_reads from m a join m b
  on a.cb = b.cb and a.gene = b.gene and a.umi <> b.umi
  and bit_count((xor(a.umi, b.umi) | (xor(a.umi, b.umi) >> 1)) & 349525) = 1)"""


def _sparse(spark, d):
    return M.molecules(V.sparse(spark, d), "n")


def _dense(spark, d):
    return M.molecules(V.dense(spark, d))


@query(with_views("dense") + DMOLS + " select * from m")
def molecule_counts(spark, d):
    return _dense(spark, d)


@query(with_views("dense") + " select cb, gene, count(distinct umi) as value from dense group by cb, gene")
def umi_dedup_exact(spark, d):
    return M.count_exact(_dense(spark, d))


@query(with_views("dense") + " select cb, gene, count(*) as value from dense group by cb, gene")
def umi_dedup_nodedup(spark, d):
    return M.count_reads(_dense(spark, d))


@query(with_views("sparse") + MOLS + EDGES + """, t as (
  select cb, gene, umi, arg_max(other, other_reads * 4096 + other) as target from e
  where (other_reads, other) > (reads, umi) group by cb, gene, umi)
select m.cb, m.gene, count(distinct coalesce(t.target, m.umi)) as value
from m left join t on m.cb = t.cb and m.gene = t.gene and m.umi = t.umi group by m.cb, m.gene""")
def umi_dedup_1mm_cr(spark, d):
    return M.count_cr(_sparse(spark, d), 5)


@query(with_views("sparse") + MOLS + EDGES + """, r as (
  select cb, gene, umi, umi as label from m
  union select r.cb, r.gene, r.umi, e.other from r join e on r.cb = e.cb and r.gene = e.gene and r.label = e.umi)
select cb, gene, count(distinct low) as value from (select cb, gene, umi, min(label) as low from r group by cb, gene, umi) group by cb, gene""")
def umi_dedup_1mm_all(spark, d):
    return M.count_components(_sparse(spark, d), 5)


# The two greedy rules have no SQL form: the tests hold them against a serial version.
@query()
def umi_dedup_directional(spark, d):
    return M.count_directional(_sparse(spark, d), 5)


@query()
def umi_dedup_umitools(spark, d):
    return M.count_directional(_sparse(spark, d), 5, -1)


@query(with_views("dense") + DMOLS + """, w as (select *, count(*) over (partition by cb, umi) as g, max(reads) over (partition by cb, umi) as x from m)
select cb, umi, gene, reads from w where g = 1 or reads >= case when x = 1 then 2 else x end""")
def umi_filter_multigene(spark, d):
    return M.filter_multi_gene(_dense(spark, d), "multi")


@query(with_views("dense") + DMOLS + """, w as (select *, count(*) over (partition by cb, umi) as g from m)
select cb, umi, gene, reads from w where g = 1""")
def umi_filter_all(spark, d):
    return M.filter_multi_gene(_dense(spark, d), "all")


@query(with_views("dense") + DMOLS + """, w as (select *, max(reads) over (partition by cb, umi) as x from m)
, k as (select *, count(*) filter (reads = x) over (partition by cb, umi) as top from w)
select cb, umi, gene, reads from k where reads = x and top = 1""")
def umi_filter_cr(spark, d):
    return M.filter_multi_gene(_dense(spark, d), "cr")


@query(with_views("sparse") + MOLS + EDGES + """, t as (
  select cb, gene, umi, arg_max(other, other_reads * 4096 + other) as target from e
  where (other_reads, other) > (reads, umi) group by cb, gene, umi)
, c as (select m.cb, m.gene, coalesce(t.target, m.umi) as umi, sum(m.reads) as reads
  from m left join t on m.cb = t.cb and m.gene = t.gene and m.umi = t.umi group by all)
, w as (select *, max(reads) over (partition by cb, umi) as x from c)
, k as (select *, count(*) filter (reads = x) over (partition by cb, umi) as top from w)
, raw as (select cb, umi, max(reads) as x from m group by cb, umi)
select k.cb, k.umi, k.gene from k left join raw on raw.cb = k.cb and raw.umi = k.umi
left join m on m.cb = k.cb and m.umi = k.umi and m.gene = k.gene
where k.reads = k.x and k.top = 1 and coalesce(m.reads, 0) >= coalesce(raw.x, 0)""")
def umi_filter_cr_full(spark, d):
    return M.filter_cr_corrected(_sparse(spark, d), 5)


@query(with_views("dense") + DMOLS + """, c as (select cb, gene, count(*) as value from m group by cb, gene)
select r.cb, n_reads, n_umis, n_genes from (select cb, cast(sum(reads) as bigint) as n_reads from m group by cb) r
join (select cb, cast(sum(value) as bigint) as n_umis, count(*) as n_genes from c group by cb) u on r.cb = u.cb""")
def cell_stats(spark, d):
    mols = _dense(spark, d)
    return M.cell_stats(mols, M.count_exact(mols))


@query(with_views("barcodes", "whitelist") + " select read_id, cb_seq, cb_idx from barcodes join whitelist using (cb_seq)")
def cb_exact_match(spark, d):
    return B.exact_match(V.barcodes(spark, d), V.whitelist(spark, d))


CANDS = """, miss as (select * from barcodes where cb_seq not in (select cb_seq from whitelist))
, cands as (select read_id, cb_idx, list_filter(range(8), lambda i: substr(m.cb_seq, i + 1, 1) <> substr(w.cb_seq, i + 1, 1))[1] as pos
  from miss m join whitelist w on len(list_filter(range(8), lambda i: substr(m.cb_seq, i + 1, 1) <> substr(w.cb_seq, i + 1, 1))) = 1)"""


@query(with_views("barcodes", "whitelist") + CANDS + """, f as (select read_id, count(*) as n, min(cb_idx) as cand from cands group by read_id)
select b.read_id, case when w.cb_idx is not null then 'exact' when f.n = 1 then 'corrected' when f.n > 1 then 'multi'
  when len(b.cb_seq) - len(replace(b.cb_seq, 'N', '')) > 1 then 'n_in_cb' else 'none' end as kind,
  coalesce(w.cb_idx, case when f.n = 1 then f.cand end) as cb_idx, coalesce(f.n, 0) as n_cands
from barcodes b left join whitelist w on b.cb_seq = w.cb_seq left join f on f.read_id = b.read_id""")
def cb_1mm_match(spark, d):
    return B.correct(V.barcodes(spark, d), V.whitelist(spark, d), size=8)


@query(with_views("barcodes", "whitelist") + CANDS + """, x as (select w.cb_idx, count(b.read_id) as exact from whitelist w left join barcodes b using (cb_seq) group by w.cb_idx)
, k as (select read_id, cb_idx, row_number() over (partition by read_id order by exact + 1 desc, pos, cb_idx) as k from cands join x using (cb_idx))
select read_id, cb_idx from k where k = 1""")
def cb_posterior(spark, d):
    reads, listed = V.barcodes(spark, d), V.whitelist(spark, d)
    return B.posterior(B.candidates(reads, listed, size=8), B.exact_counts(reads, listed))


@query("""select a.r_name || b.r_name as cb_seq from region a, region b""")
def wl_product(spark, d):
    seg = V.table(spark, d, "region").select(F.col("r_name").alias("seg"))
    return B.whitelist_product(seg, seg)


OVERLAP = """, h as (select distinct read_id, gene, gene_reverse = is_reverse as same from aln join genes
  on aln.chr = genes.chr and r_start < "end" and r_end > "start")"""


@query(with_views("aln", "genes") + OVERLAP + " select read_id, gene, same from h")
def gene_overlap(spark, d):
    return G.overlapping_genes(V.alignments(spark, d), V.gene_intervals(spark, d), 512)


ONE = """, one as (select * from (select *, row_number() over (partition by read_id order by chr, "start", "end", is_reverse) as k from aln) where k = 1)"""


@query(with_views("aln", "genes") + ONE + OVERLAP.replace("from aln", "from one").replace("aln.", "one.") + """, s as (
  select a.read_id, count(distinct gene) as n, count(distinct gene) filter (same) as ns, count(distinct gene) filter (not same) as no,
    min(gene) as g, min(gene) filter (same) as gs, min(gene) filter (not same) as go
  from one a left join h on h.read_id = a.read_id where a.n_loci = 1 group by a.read_id)
, l as (
  select 'a' as c, case when n = 0 then 'N_noFeature' when n = 1 then cast(g as varchar) else 'N_ambiguous' end as feature from s
  union all select 's', case when ns = 0 then 'N_noFeature' when ns = 1 then cast(gs as varchar) else 'N_ambiguous' end from s
  union all select 'o', case when no = 0 then 'N_noFeature' when no = 1 then cast(go as varchar) else 'N_ambiguous' end from s)
select feature, count(*) filter (c = 'a') as any_strand, count(*) filter (c = 's') as same_strand, count(*) filter (c = 'o') as other_strand from l group by feature
union all select case when n_loci = 0 then 'N_unmapped' else 'N_multimapping' end, count(*), count(*), count(*) from one where n_loci <> 1 group by n_loci = 0""")
def gene_counts_3col(spark, d):
    place = F.min(F.struct("chr", "start", "end", "is_reverse", "n_loci")).alias("first")  # of a read's places the first
    one = V.alignments(spark, d).groupBy("read_id").agg(place).select("read_id", "first.*")
    return G.three_column_counts(one, V.gene_intervals(spark, d), 512)


@query(with_views("aln", "genes") + """, h as (select distinct read_id, gene from aln join genes on aln.chr = genes.chr and r_start <= "start" and r_end >= "end")
, s as (select a.read_id, count(distinct gene) as n, min(gene) as g from (select distinct read_id from aln) a left join h using (read_id) group by a.read_id)
select read_id, case when n = 0 then 'no_feature' when n = 1 then 'gene' else 'ambiguous' end as status, case when n = 1 then g end as gene from s""")
def gene_concordant(spark, d):
    reads = V.alignments(spark, d)
    return G.assign(G.concordant_genes(reads, V.gene_intervals(spark, d), 512), reads)


REGIONS = """, bodies as (select chr, r_start, r_end + 200 as r_end, gene, gene_reverse from genes)
, g as (select a.read_id, bool_or(r_start < "end" and genes_end > "start") as ex, bool_or(gene_reverse = is_reverse) as sense, bool_or(gene_reverse <> is_reverse) as opposite
  from aln a join (select *, r_end - 200 as genes_end from bodies) b on a.chr = b.chr and b.r_start < a."end" and b.r_end > a."start" group by a.read_id)
, r as (select a.read_id, case when ex then 'exonic' when sense is not null then 'intronic' else 'intergenic' end as region, coalesce(opposite and not sense, false) as antisense
  from (select distinct read_id from aln) a left join g using (read_id))"""


def _regions(spark, d):
    genes = V.gene_intervals(spark, d)
    return G.regions(V.alignments(spark, d), genes, genes.withColumn("r_end", F.col("r_end") + 200), 512)


@query(with_views("aln", "genes") + REGIONS + " select * from r")
def read_regions(spark, d):
    return _regions(spark, d)


@query(with_views("aln", "genes") + REGIONS + " select region, count(*) as reads, count(*) filter (antisense) as antisense_reads from r group by region")
def region_funnel(spark, d):
    return _regions(spark, d).groupBy("region").agg(
        F.count(F.lit(1)).alias("reads"), F.sum(F.col("antisense").cast("long")).alias("antisense_reads")
    )


@query("""with m as (select l_suppkey as cb, l_orderkey % 8 as gene, l_partkey % 64 as umi,
  max(case when l_linenumber % 3 > 0 then 2 when l_quantity > 25 then 1 else 3 end) as w from lineitem group by all)
select cb, gene, count(*) filter (w = 2) as spliced, count(*) filter (w = 3) as unspliced, count(*) filter (w = 1) as ambiguous from m group by cb, gene""")
def velocyto(spark, d):
    x = V.table(spark, d, "lineitem")
    return G.velocyto(x.select(
        F.col("l_suppkey").alias("cb"), (F.col("l_orderkey") % 8).alias("gene"), (F.col("l_partkey") % 64).alias("umi"),
        (F.col("l_linenumber") % 3).alias("junctions"), (F.col("l_quantity") > 25).alias("exonic"),
    ))


COLLAPSE = """, c as (select chr, "start", "end", strand, motif, count(*) filter (is_unique) as n_unique, count(*) filter (not is_unique) as n_multi,
  max(overhang) as overhang, bool_or(annotated) as annotated from obs group by chr, "start", "end", strand, motif)"""
SURVIVE = """, n as (select *, least(
    greatest(0, "start" - lag("end") over w), greatest(0, lead("start") over w - "end")) as gap,
    case when motif = 0 then 1 when motif <= 2 then 2 when motif <= 4 then 3 else 4 end as k from c
  window w as (partition by chr order by "start", "end", strand, motif))
, kept as (select chr, "start", "end", strand, motif, n_unique, n_multi, overhang, annotated from n where annotated or (
  overhang >= [30, 12, 12, 12][k] and (n_unique >= [3, 1, 1, 1][k] or n_unique + n_multi >= [3, 1, 1, 1][k])
  and not ([10, 0, 5, 10][k] > 0 and coalesce(gap < [10, 0, 5, 10][k], false))
  and "end" - "start" <= case when n_unique + n_multi >= 3 then 200000 when n_unique + n_multi >= 2 then 100000 else 50000 end))"""


@query(with_views("obs") + """ select read_id, chr, "start", "end", max(overhang) as overhang, bool_or(annotated) as annotated, min(strand) as strand,
  min(motif) as motif, bool_and(is_unique) as is_unique from obs group by read_id, chr, "start", "end" """)
def sj_per_read(spark, d):
    return J.per_read(V.junction_obs(spark, d))


@query(with_views("obs") + COLLAPSE + " select * from c")
def sj_collapse(spark, d):
    return J.collapse(V.junction_obs(spark, d))


@query(with_views("obs") + COLLAPSE + SURVIVE + " select * from kept")
def sj_filter(spark, d):
    return J.surviving(J.collapse(V.junction_obs(spark, d)))


@query(with_views("obs") + COLLAPSE + """ select * from c where not annotated and (overhang >= 5 or n_unique + n_multi >= 3) and "end" - "start" + 1 <= 589824""")
def sj_novel(spark, d):
    return J.novel(J.collapse(V.junction_obs(spark, d)))


@query(with_views("obs") + COLLAPSE + SURVIVE + """, bad as (select distinct read_id from obs where not exists
  (select 1 from kept where kept.chr = obs.chr and kept."start" = obs."start" and kept."end" = obs."end"))
select o_orderkey as read_id from orders where o_orderkey not in (select read_id from bad)""")
def bysj_antijoin(spark, d):
    obs = V.junction_obs(spark, d)
    reads = V.table(spark, d, "orders").select(F.col("o_orderkey").alias("read_id"))
    return J.reads_by_junctions(reads, obs, J.surviving(J.collapse(obs)))


@query("""with x as (select l_orderkey as t, l_partkey % 5 as chr, l_linenumber * 1000 + l_partkey % 7 as s, l_linenumber * 1000 + 300 as e from lineitem)
, n as (select chr, e + 1 as "start", lead(s) over (partition by t, chr order by s, e) - 1 as "end" from x)
select distinct chr, "start", "end" from n where "end" > "start" """)
def sj_from_exons(spark, d):
    x = V.table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("transcript"), (F.col("l_partkey") % 5).alias("chr"),
        (F.col("l_linenumber") * 1000 + F.col("l_partkey") % 7).alias("start"), (F.col("l_linenumber") * 1000 + 300).alias("end"),
    )
    return J.from_exons(x)


@query(with_views("obs") + """, r as (select chr, "start", "end", row_number() over (order by chr, "start", "end") - 1 as sj from (select distinct chr, "start", "end" from obs))
select obs.read_id % 50 as cb, sj, count(distinct obs.read_id % 64) as value from obs join r on obs.chr = r.chr and obs."start" = r."start" and obs."end" = r."end" group by 1, 2""")
def sj_matrix(spark, d):
    from helixframe.operators.ranking import global_rank

    obs = V.junction_obs(spark, d)
    rows = global_rank(obs.select("chr", "start", "end").distinct(), [F.col("chr"), F.col("start"), F.col("end")], "sj").withColumn("sj", F.col("sj") - 1)
    return J.matrix(obs.select((F.col("read_id") % 50).alias("cb"), (F.col("read_id") % 64).alias("umi"), "chr", "start", "end"), rows)


@query(with_views("pos") + """, s as (select chr, "start" as p, 1 as d from pos union all select chr, "end", -1 from pos)
, t as (select chr, p, sum(d) as d from s group by chr, p having sum(d) <> 0)
, r as (select chr, p as "start", lead(p) over (partition by chr order by p) as "end", cast(sum(d) over (partition by chr order by p) as bigint) as value from t)
select * from r where value <> 0""")
def coverage_bedgraph(spark, d):
    return I.coverage(V.positions(spark, d), width=86_400)


ISLANDS = """, n as (select chr, "start", "end", case when "start" <= max("end") over (partition by chr order by "start", "end" rows between unbounded preceding and 1 preceding)
    then 0 else 1 end as f from pos)
, i as (select *, sum(f) over (partition by chr order by "start", "end" rows unbounded preceding) as cluster from n)"""


@query(with_views("pos") + ISLANDS + """ select chr, min("start") as "start", max("end") as "end" from i group by chr, cluster""")
def merge_islands(spark, d):
    return I.merge_islands(V.positions(spark, d), ["chr"])


@query(with_views("pos") + ISLANDS + """ select chr, cast(cluster as bigint) as cluster, count(*) as n from i group by chr, cluster""")
def overlap_clusters(spark, d):
    return I.overlap_clusters(V.positions(spark, d), ["chr"]).groupBy("chr", "cluster").agg(F.count(F.lit(1)).alias("n"))


MATED = """with s as (select l_orderkey % 5 as chr, l_partkey * 40 as pos, case when l_linenumber = 1 then l_partkey * 40 + l_suppkey + 30 end as mate_pos,
  (l_orderkey * 8 + l_linenumber) * 1000000 + l_partkey as record from lineitem)
, d as (select chr, pos, min(mate_pos) as mate_pos, record from s group by chr, pos, record)"""


@query(MATED + """, p as (select *, max(mate_pos) over w as past, count(mate_pos) over w as g from d
  window w as (partition by chr order by pos, record rows between unbounded preceding and 1 preceding))
, f as (select *, g > 0 and pos > past as beyond from p)
, n as (select *, beyond and row_number() over (partition by chr, g, beyond order by pos, record) = 1 as new from f)
, c as (select *, 1 + count(*) filter (new) over (partition by chr order by pos, record) as cluster from n)
select chr, cluster, count(*) as n from c group by chr, cluster""")
def mate_clusters(spark, d):
    x = V.table(spark, d, "lineitem").select(
        (F.col("l_orderkey") % 5).alias("chr"), (F.col("l_partkey") * 40).alias("pos"),
        F.when(F.col("l_linenumber") == 1, F.col("l_partkey") * 40 + F.col("l_suppkey") + 30).alias("mate_pos"),
        ((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 1_000_000 + F.col("l_partkey")).alias("record"),
    )
    x = x.groupBy("chr", "pos", "record").agg(F.min("mate_pos").alias("mate_pos"))
    return I.mate_clusters(x, ["chr"]).groupBy("chr", "cluster").agg(F.count(F.lit(1)).alias("n"))


@query(with_views("scored") + """, r as (select *, row_number() over (partition by read_id order by score desc, n_junction, chr, "start", is_reverse) as hit,
  count(*) over (partition by read_id) as k from scored)
select read_id, chr, "start", score, cast(hit as integer) as hit, case when k = 1 then 255 when k = 2 then 3 when k <= 4 then 1 else 0 end as mapq from r""")
def primary_rank(spark, d):
    return A.ranked(V.scored(spark, d)).select("read_id", "chr", "start", "score", "hit", "mapq")


@query(with_views("scored") + """, b as (select *, max(score) over (partition by read_id) as best from scored)
select read_id, "start", score from b where score >= best - 5""")
def score_range_filter(spark, d):
    return A.within_score_range(V.scored(spark, d), 5).select("read_id", "start", "score")


@query(with_views("scored") + """ select read_id, "start", score from scored where score >= 65 and n_match >= 99 * 0.66 and n_mismatch <= 10 and n_mismatch <= 30""")
def quality_filter(spark, d):
    return A.quality_filter(V.scored(spark, d)).select("read_id", "start", "score")


@query(with_views("scored") + """, b as (select *, count(*) over (partition by read_id) as n_loci from scored)
select read_id, "start", n_loci from b where n_loci <= 4""")
def loci_filter(spark, d):
    return A.drop_many_loci(V.scored(spark, d), 4).select("read_id", "start", "n_loci")


@query(with_views("aln") + """ select count(*) as reads, count(*) filter (n_loci = 1) as unique_reads, count(*) filter (n_loci in (2)) as multi_reads,
  count(*) filter (n_loci > 2) as many_reads, count(*) filter (n_loci = 0) as unmapped from aln""")
def mapping_counters(spark, d):
    return A.mapping_counters(V.alignments(spark, d), 2)


@query("""select cast(sum(10 + l_linenumber + 20) as bigint) as m_bases, cast(sum(l_partkey % 3 + 1) as bigint) as i_bases, cast(sum(l_suppkey % 4 + 1) as bigint) as d_bases,
  count(*) as insertions, count(*) as deletions, count(*) as splices from lineitem""")
def cigar_counters(spark, d):
    x = V.table(spark, d, "lineitem")
    cigar = F.concat((F.col("l_linenumber") + 10).cast("string"), F.lit("M"), (F.col("l_partkey") % 3 + 1).cast("string"), F.lit("I"), (F.col("l_suppkey") % 4 + 1).cast("string"), F.lit("D500N20M"))
    return A.cigar_counters(x.select(cigar.alias("cigar")))


@query("""select l_orderkey as read_id, l_linenumber as line, l_partkey * 50 + l_linenumber + 10 as first, l_partkey * 50 + l_linenumber + 10 + l_suppkey + 20 as last from lineitem""")
def cigar_junctions(spark, d):
    x = V.table(spark, d, "lineitem")
    cigar = F.concat((F.col("l_linenumber") + 10).cast("string"), F.lit("M"), (F.col("l_suppkey") + 21).cast("string"), F.lit("N30M"))
    rows = x.select(F.col("l_orderkey").alias("read_id"), F.col("l_linenumber").alias("line"), F.explode(S.cigar_introns(F.col("l_partkey") * 50, S.parse_cigar(cigar))).alias("j"))
    return rows.select("read_id", "line", F.col("j.first").alias("first"), F.col("j.last").alias("last"))


@query(with_views("cells") + " select cb from (select cb from cells order by n_umis desc, cb limit 50)")
def topcells(spark, d):
    return C.top_cells(V.cells(spark, d), 50)


@query(with_views("cells") + """, t as (select ceil(min(n_umis) / 10.0) as threshold from (select n_umis from cells order by n_umis desc limit 31))
select cb from cells, t where n_umis >= threshold""")
def knee_cells(spark, d):
    return C.knee_cells(V.cells(spark, d))


@query(with_views("cells") + """, r as (select cb, n_umis, row_number() over (order by n_umis desc, cb) as rank from cells)
select * from r where rank between 11 and 100""")
def umi_rank_slice(spark, d):
    return C.umi_rank(V.cells(spark, d), 11, 100)


@query(with_views("dense") + DMOLS + """, c as (select cb, gene, count(*) as value from m group by cb, gene)
, s as (select r.cb, n_reads, n_umis, n_genes from (select cb, sum(reads) as n_reads from m group by cb) r
  join (select cb, sum(value) as n_umis, count(*) as n_genes from c group by cb) u on r.cb = u.cb)
, t as (select ceil(min(n_umis) / 10.0) as threshold from (select n_umis from s order by n_umis desc limit 31))
, i as (select s.* from s, t where n_umis >= threshold)
select (select cast(sum(n_reads) as bigint) from s) as reads, (select cast(sum(n_umis) as bigint) from s) as umis, count(*) as n_cells,
  cast(sum(n_umis) as bigint) as umis_in_cells, cast(floor(avg(n_umis)) as bigint) as mean_umis, cast(floor(avg(n_reads)) as bigint) as mean_reads,
  cast(floor(avg(n_genes)) as bigint) as mean_genes, cast(floor(median(n_umis)) as bigint) as median_umis, cast(floor(median(n_genes)) as bigint) as median_genes,
  (select count(distinct gene) from c where cb in (select cb from i)) as genes_detected,
  round(1 - (select sum(n_umis) from s) / (select sum(n_reads) from s), 6) as saturation from i""")
def summary(spark, d):
    mols = _dense(spark, d)
    counts = M.count_exact(mols)
    cells = M.cell_stats(mols, counts)
    return C.summary(cells, counts, C.knee_cells(cells))


@query("""with v as (select p_partkey, p_retailprice / 10000.0 as p from part)
, r as (select *, count(*) over () as n, count(*) over (order by p) as k from v)
, q as (select p, min(n * p / k) as q from r group by p)
, a as (select p, least(1.0, min(q) over (order by p desc rows unbounded preceding)) as p_adj from q)
select p_partkey, round(p_adj, 6) as p_adj from v join a using (p)""")
def bh_adjust(spark, d):
    x = V.table(spark, d, "part").select("p_partkey", (F.col("p_retailprice") / 10000.0).alias("p"))
    return adjust_p(x).select("p_partkey", F.round("p_adj", 6).alias("p_adj"))


SHARED = """, b as (select s.cb, molecule, s.gene, coalesce(value, 0) as u, 1.0 / count(*) over (partition by s.cb, molecule) as even
  from sets_ s left join uniq on uniq.cb = s.cb and uniq.gene = s.gene where s.cb in (select cb from uniq))"""
TOTAL = " select cb, gene, round(sum(value), 6) as value from (select cb, gene, value from uniq union all select cb, gene, part from p) group by cb, gene"


def _shared(spark, d, method):
    out = M.share_multi(V.unique_genes(spark, d), V.gene_sets(spark, d), method)
    return out.select("cb", "gene", F.round("value", 6).alias("value"))


@query(with_views("rows_", "sets_", "uniq") + SHARED + ", p as (select cb, gene, even as part from b)" + TOTAL)
def multimap_uniform(spark, d):
    return _shared(spark, d, "uniform")


@query(with_views("rows_", "sets_", "uniq") + SHARED + """, t as (select *, sum(u) over (partition by cb, molecule) as t from b)
, p as (select cb, gene, case when t > 0 then cast(u as double) / t else even end as part from t)""" + TOTAL)
def multimap_propunique(spark, d):
    return _shared(spark, d, "prop_unique")


@query(with_views("rows_", "sets_", "uniq") + SHARED + """, w as (select *, u + sum(even) over (partition by cb, gene) as w from b)
, t as (select *, sum(w) over (partition by cb, molecule) as t from w)
, p as (select cb, gene, case when t > 0 then cast(w as double) / t else even end as part from t)""" + TOTAL)
def multimap_rescue(spark, d):
    return _shared(spark, d, "rescue")


@query()
def multimap_em(spark, d):
    out = M.share_multi_em(V.unique_genes(spark, d), V.gene_sets(spark, d))
    return out.select("cb", "gene", F.round("value", 4).alias("value"))


@query(with_views("chain") + """, b as (select *, lead(s2) over (partition by chr order by s1) as n2, min(s1) over (partition by chr) as head from chain)
, p as (select event_id as id, user_id % 5 as chr, event_id * 11 as pos, event_id % 2 = 1 as is_end from events)
, j as (select p.*, b.s1, b.s2, b.len, b.n2, row_number() over (partition by p.id order by b.s1 desc) as k
  from p left join b on b.chr = p.chr and b.s1 <= p.pos)
select id, j.chr, pos, is_end, case when j.s1 is not null and pos < j.s1 + j.len then j.s2 + pos - j.s1 when is_end then j.s2 + j.len - 1
  when j.s1 is null then h.s2 else n2 end as lifted
from j left join (select chr, arg_min(s2, s1) as s2 from chain group by chr) h on h.chr = j.chr where k = 1""")
def liftover(spark, d):
    x = V.table(spark, d, "events")
    points = x.select(F.col("event_id").alias("id"), (F.col("user_id") % 5).alias("chr"), (F.col("event_id") * 11).alias("pos"), (F.col("event_id") % 2 == 1).alias("is_end"))
    return A.lift(points, V.chain_blocks(spark, d))


@query("""select o_orderkey as pair_id, row_number() over (partition by o_custkey % 200, o_orderstatus, o_orderpriority
  order by cast(floor(o_totalprice) as bigint) desc, o_orderkey) > 1 as duplicate from orders""")
def dup_mark(spark, d):
    x = V.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("pair_id"), (F.col("o_custkey") % 200).alias("unclip"), F.col("o_orderstatus").alias("flag"), F.col("o_orderpriority").alias("cigar"),
        F.floor("o_totalprice").alias("score"),
    )
    return A.mark_duplicates(x, ["unclip", "flag", "cigar"]).select("pair_id", "duplicate")


@query(with_views("seqs") + " select doc_id, reverse(translate(seq, 'ACGT', 'TGCA')) as rc from seqs")
def revcomp(spark, d):
    return V.sequences(spark, d).select("doc_id", S.reverse_complement(F.col("seq")).alias("rc"))


@query(with_views("seqs") + """ select doc_id, substr(seq, 1, 12) as bases, case when len(seq) >= 12 and not contains(substr(seq, 1, 12), 'N') then
  cast(list_sum(list_transform(range(12), lambda i: (strpos('ACGT', substr(seq, i + 1, 1)) - 1) * (1 << (22 - 2 * i)))) as bigint) end as packed from seqs""")
def barcode_pack(spark, d):
    first = F.substring("seq", 1, 12)
    return V.sequences(spark, d).select("doc_id", first.alias("bases"), S.pack_bases(first, 12).alias("packed"))


@query(with_views("seqs") + """ select doc_id, case when len(seq) > 15 then substr(seq, 6, len(seq) - 15) else '' end as clipped from seqs""")
def clip_reads(spark, d):
    return V.sequences(spark, d).select("doc_id", S.clip(F.col("seq"), 5, 10).alias("clipped"))


@query(with_views("seqs") + """, x as (select doc_id, substr(seq, 17, 10) as umi, len(seq) as n, substr(seq, 1, 16) as cb from seqs)
select doc_id, cb, umi, not contains(umi, 'N') and replace(umi, substr(umi, 1, 1), '') <> '' as valid from x where n >= 26""")
def solo_barcodes(spark, d):
    parts = S.barcode_parts(F.col("seq"), F.col("seq"))
    rows = V.sequences(spark, d).select("doc_id", parts.alias("p")).filter("p is not null").select("doc_id", "p.cb", "p.umi")
    return rows.withColumn("valid", S.valid_umi(F.col("umi")))


@query(with_views("barcodes", "whitelist", "aln", "genes") + """, g as (select read_id, min(gene) as gene from (select distinct a.read_id, gene from aln a join genes
  on a.chr = genes.chr and r_start <= "start" and r_end >= "end" and gene_reverse = is_reverse) group by read_id having count(*) = 1)
, o as (select cb_idx, l_partkey % 1024 as umi, gene from lineitem join g on g.read_id = ((l_orderkey * 8 + l_linenumber) * 1000000 + l_partkey) * 10000 + l_suppkey
  join barcodes b on b.read_id = g.read_id join whitelist w on w.cb_seq = b.cb_seq)
select gene as gene_idx, cb_idx, count(distinct umi) as value from o group by gene, cb_idx""")
def solo_gene_matrix(spark, d):
    """Barcodes, gene assignment and UMIs of the same reads to a count matrix."""
    genes = G.assign_single_blocks(V.alignments(spark, d), V.gene_intervals(spark, d), "forward", 512)
    cbs = B.exact_match(V.barcodes(spark, d), V.whitelist(spark, d)).select("read_id", F.col("cb_idx").alias("cb"))
    umis = V.table(spark, d, "lineitem").select(F.expr(V.READ_ID).alias("read_id"), (F.col("l_partkey") % 1024).alias("umi"))
    obs = umis.join(genes, "read_id").join(cbs, "read_id")
    return M.count_exact(M.molecules(obs)).select(F.col("gene").alias("gene_idx"), F.col("cb").alias("cb_idx"), "value")


@query()
def empty_drops(spark, d):
    x = V.table(spark, d, "lineitem").select((F.col("l_orderkey") % 3000).alias("cb"), (F.col("l_partkey") % 300).alias("gene"))
    return C.empty_drops(x.groupBy("cb", "gene").agg(F.count(F.lit(1)).alias("value")), lower=18, expected=300)
