"""Queries of the alignment rules, chimeric junctions, barcode layouts and gene models, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixframe.functions import sequence as S
from helixframe.operators import alignments as A
from helixframe.operators import chimeric as X
from helixframe.operators import filters as P
from helixframe.operators import genes as G
from helixframe.operators import models as D
from helixframe.operators.storage import scratch
from helixframe.plans import adapters as V
from helixframe.plans.adapters import with_views
from helixframe.plans.registry import query
from helixframe.sinks import text as sinks
from helixframe.sources import text as sources

MOTIFS = """with a as (select distinct l_orderkey as read_id, l_linenumber as line, l_partkey as part, l_partkey % 7 as m1, l_suppkey % 7 as m2, l_partkey % 2 = 0 as a1, l_suppkey % 2 = 0 as a2
  from lineitem)"""


def _motifs(spark, d):
    x = V.table(spark, d, "lineitem")
    return x.select(
        F.col("l_orderkey").alias("read_id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"),
        F.array((F.col("l_partkey") % 7).cast("int"), (F.col("l_suppkey") % 7).cast("int")).alias("motifs"),
        F.array(F.col("l_partkey") % 2 == 0, F.col("l_suppkey") % 2 == 0).alias("annotated"),
    ).distinct()


@query(MOTIFS + " select read_id, line, part from a where m1 <> 0 and m2 <> 0")
def motif_filter(spark, d):
    return P.allowed_motifs(_motifs(spark, d), "remove_noncanonical").select("read_id", "line", "part")


@query(MOTIFS + " select read_id, line, part from a where (m1 <> 0 or a1) and (m2 <> 0 or a2)")
def motif_filter_unannotated(spark, d):
    return P.allowed_motifs(_motifs(spark, d), "remove_noncanonical_unannotated").select("read_id", "line", "part")


@query(MOTIFS + " select read_id, line, part from a where m1 = 0 or m2 = 0 or m1 % 2 = m2 % 2")
def strand_filter(spark, d):
    return P.consistent_strands(_motifs(spark, d)).select("read_id", "line", "part")


@query("""select distinct l_orderkey as read_id, l_linenumber as line from lineitem
where l_linenumber % 3 = 0 or cast(floor(l_quantity) as integer) * 2 >= greatest(20, cast(floor(100 * 0.66) as integer))""")
def spliced_length_filter(spark, d):
    x = V.table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("read_id"), F.col("l_linenumber").alias("line"), (F.col("l_linenumber") % 3).alias("n_junction"),
        (F.floor("l_quantity") * 2).alias("mapped_len"), F.lit(100).alias("mate_len"),
    )
    return P.long_enough_if_spliced(x, 20).select("read_id", "line").distinct()


@query("""with t as (select l_orderkey as read_id, case l_partkey % 4 when 1 then 'mismatch_max' when 2 then 'score' when 3 then 'mismatch_rate' end as failed from lineitem where l_linenumber < 3)
, s as (select read_id, bool_or(failed is null) as mapped, bool_and(coalesce(failed like 'mismatch%', false)) as mism from t group by read_id)
select o_orderkey as read_id, case when mapped is null then 'other' when mism then 'too_many_mismatches' else 'too_short' end as reason
from orders left join s on o_orderkey = read_id where not coalesce(mapped, false)""")
def unmapped_reasons(spark, d):
    kind = F.col("l_partkey") % 4
    failed = F.when(kind == 1, "mismatch_max").when(kind == 2, "score").when(kind == 3, "mismatch_rate")
    tried = V.table(spark, d, "lineitem").filter("l_linenumber < 3").select(F.col("l_orderkey").alias("read_id"), failed.alias("failed"))
    return P.unmapped_reasons(V.table(spark, d, "orders").select(F.col("o_orderkey").alias("read_id")), tried)


PAIRS = """with p as (select l_orderkey as read_id, ((l_linenumber * 100000 + l_partkey) * 10000 + l_suppkey) * 100 + cast(floor(l_quantity) as bigint) as pair_no,
  cast(floor(l_quantity) as integer) * 4 as score, l_suppkey % 5 as chr1, l_partkey * 50 as start1, l_returnflag = 'R' as reverse1,
  100 as len1, 90 as len2, cast(floor(l_quantity) as integer) * 4 + 5 as n_match, l_partkey % 14 as n_mismatch from lineitem)
, u as (select distinct * from p)"""


def _pairs(spark, d):
    q = F.floor("l_quantity")
    return V.table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("read_id"),
        (((F.col("l_linenumber").cast("long") * 100_000 + F.col("l_partkey")) * 10_000 + F.col("l_suppkey")) * 100 + q).alias("pair_no"),
        (q * 4).cast("int").alias("score"), (F.col("l_suppkey") % 5).alias("chr1"), (F.col("l_partkey") * 50).alias("start1"),
        (F.col("l_returnflag") == "R").alias("reverse1"), F.lit(100).alias("len1"), F.lit(90).alias("len2"), (q * 4 + 5).alias("n_match"),
        (F.col("l_partkey") % 14).alias("n_mismatch"),
    ).distinct()


@query(PAIRS + """ select read_id, pair_no, score, cast(row_number() over (partition by read_id order by score desc, chr1, start1, reverse1, pair_no) as integer) as hit from u""")
def pair_rank(spark, d):
    return P.ranked_pairs(_pairs(spark, d)).select("read_id", "pair_no", "score", "hit")


@query(PAIRS + """, b as (select read_id, count(*) as n, arg_max(score >= 125 and n_match >= 125 and n_mismatch <= 10 and n_mismatch <= 57, (score, chr1, start1, reverse1, pair_no)) as ok from u group by read_id)
select u.read_id, pair_no from u join b using (read_id) where ok and n <= 4""")
def pair_quality(spark, d):
    return P.good_pairs(_pairs(spark, d), most=4).select("read_id", "pair_no")


@query(with_views("scored") + """, r as (select *, row_number() over (partition by read_id order by score desc, n_junction, chr, "start", is_reverse) as hit,
  count(*) over (partition by read_id) as k from scored)
select read_id, "start", cast(hit as integer) as hit, least(k, 2) as nh, case when k = 1 then 255 when k = 2 then 3 when k <= 4 then 1 else 0 end as mapq from r where hit <= 2""")
def reported_hits(spark, d):
    return P.first_hits(A.ranked(V.scored(spark, d)), 2).select("read_id", "start", "hit", "nh", "mapq")


@query("""with f as (select distinct o_orderkey as read_id, o_custkey % 5 as chr, o_custkey * 40 as s1, o_custkey * 40 + 60 as e1, o_custkey * 40 + 200 as s2, o_custkey * 40 + 260 as e2,
  o_orderstatus = 'F' as reverse1 from orders)
, m as (select read_id, chr, reverse1, unnest([s1, s2]) as s, unnest([e1, e2]) as e from f)
, h as (select distinct m.read_id, gene from m join (select p_partkey % 5 as chr, p_partkey * 50 as r_start, p_partkey * 50 + p_size * 10 as r_end, p_partkey as gene, p_size % 2 = 0 as rev from part) g
  on m.chr = g.chr and r_start < e and r_end > s and rev = reverse1)
select f.read_id, count(gene) as n_genes from f left join h using (read_id) group by f.read_id""")
def pair_genes(spark, d):
    """Genes of pairs on the first mate's strand."""
    x = V.table(spark, d, "orders")
    at = F.col("o_custkey") * 40
    pairs = x.select(
        F.col("o_orderkey").alias("read_id"), (F.col("o_custkey") % 5).alias("chr"), at.alias("start1"), (at + 60).alias("end1"), (at + 200).alias("start2"),
        (at + 260).alias("end2"), (F.col("o_orderstatus") == "F").alias("reverse1"),
    ).distinct()
    hits = G.overlapping_genes(P.pair_observations(pairs), V.gene_intervals(spark, d), 512).filter("same")
    n = hits.groupBy("read_id").agg(F.count_distinct("gene").alias("n"))
    return pairs.select("read_id").distinct().join(n, "read_id", "left").select("read_id", F.coalesce("n", F.lit(0)).alias("n_genes"))


@query(with_views("aln", "genes") + """, g as (select a.read_id, count(distinct gene) as n, min(gene) as gene from (select distinct read_id from aln) a
  left join (select distinct read_id, gene from aln join genes on aln.chr = genes.chr and r_start <= "start" and r_end >= "end") h using (read_id) group by a.read_id)
select read_id, case when n = 1 then cast(gene as varchar) else '-' end as gx, case when n = 1 then 'P' || gene else '-' end as gn from g""")
def gene_tags(spark, d):
    reads = V.alignments(spark, d)
    names = V.table(spark, d, "part").select(F.col("p_partkey").alias("gene"), F.concat(F.lit("P"), "p_partkey").alias("name"))
    return G.tags(G.assign(G.concordant_genes(reads, V.gene_intervals(spark, d), 512), reads), names)


SEGMENTS = """with s as (select distinct l_orderkey as read_id, l_linenumber as seg, l_suppkey % 2 as chr, l_partkey * 3000 as "start", l_partkey * 3000 + 40 as "end", l_returnflag = 'R' as rev from lineitem
  where l_linenumber <= 3)"""


@query(SEGMENTS + """ select a.read_id, a.seg as seg1, b.seg as seg2, a."start" as start1, b."start" as start2 from s a join s b on a.read_id = b.read_id and a.seg < b.seg
where a.chr <> b.chr or a.rev <> b.rev or greatest(b."start" - a."end", a."start" - b."end", 0) > 1000000""")
def chimeric_pairs(spark, d):
    at = F.col("l_partkey") * 3000
    rows = V.table(spark, d, "lineitem").filter("l_linenumber <= 3").select(
        F.col("l_orderkey").alias("read_id"), F.col("l_linenumber").alias("seg"), (F.col("l_suppkey") % 2).alias("chr"), at.alias("start"), (at + 40).alias("end"),
        (F.col("l_returnflag") == "R").alias("is_reverse"),
    ).distinct()
    return X.chimeric_pairs(rows).select(
        "read_id", F.col("first.seg").alias("seg1"), F.col("second.seg").alias("seg2"), F.col("first.start").alias("start1"), F.col("second.start").alias("start2")
    )


@query(with_views("seqs") + """, x as (select doc_id, substr(seq, 1, 20) as a, reverse(substr(seq, 21, 20)) as b, doc_id % 3 > 0 as same, substr(seq, 1, 2) as don, substr(seq, 3, 2) as acc from seqs)
, y as (select *, least(len(a), len(b)) as n, list_filter(range(1, 21), lambda i: i <= least(len(a), len(b)) and (substr(a, i, 1) <> substr(b, i, 1) or substr(a, i, 1) = 'N'))[1] as bad from x)
select doc_id, case when same then case don || acc when 'GTAG' then 1 when 'CTAC' then 2 when 'GCAG' then 3 when 'CTGC' then 4 when 'ATAC' then 5 when 'GTAT' then 6 else 0 end else 0 end as kind,
  cast(case when not same then 0 else coalesce(bad - 1, n) end as integer) as repeat from y""")
def chimeric_junctions(spark, d):
    same = F.col("doc_id") % 3 > 0
    part = lambda at, n: F.substring("seq", at, n)
    return V.sequences(spark, d).select(
        "doc_id", X.junction_type(same, part(1, 2), part(3, 2)).alias("kind"), X.repeat_length(same, part(1, 20), part(21, 20)).cast("int").alias("repeat")
    )


@query(with_views("seqs") + """ select doc_id, substr(seq, 1, 4) || substr(seq, 7, 4) as cb, substr(seq, 13, 8) as umi from seqs where len(seq) >= 20""")
def complex_barcodes(spark, d):
    parts = S.complex_parts(F.col("seq"), F.col("seq"), ["0_0_0_3", "0_6_0_9"], "0_12_0_19")
    return V.sequences(spark, d).select("doc_id", parts.alias("p")).filter("p is not null").select("doc_id", "p.cb", "p.umi")


@query("""with j as (select distinct l_suppkey % 5 as chr, l_partkey % 40 as "start", l_partkey % 40 + 100 as "end", l_partkey % 7 as motif,
  case when l_linenumber % 3 = 0 then 0 when l_returnflag = 'R' then 2 else 1 end as strand from lineitem)
, g as (select chr, "start", "end", list_reduce(list_sort(list({'k': strand, 'm': motif})), lambda a, b: case
    when a.k > 0 and b.k = 0 then a when a.k = 0 and b.k > 0 then b when a.m = 0 and b.m = 0 then {'k': 0, 'm': a.m}
    when a.m > 0 and b.m = 0 then a when a.m = 0 and b.m > 0 then b when a.k = 2 - a.m % 2 then a else b end) as x from j group by all)
select chr, "start", "end", cast(x.m as integer) as motif, cast(x.k as integer) as strand from g""")
def sj_one_strand(spark, d):
    strand = F.when(F.col("l_linenumber") % 3 == 0, 0).when(F.col("l_returnflag") == "R", 2).otherwise(1)
    at = F.col("l_partkey") % 40
    rows = V.table(spark, d, "lineitem").select((F.col("l_suppkey") % 5).alias("chr"), at.alias("start"), (at + 100).alias("end"), (F.col("l_partkey") % 7).alias("motif"), strand.alias("strand"))
    return D.one_strand(rows)


@query("""select count(*) as reads, cast(floor(avg(100)) as bigint) as mean_length, count(*) filter (k = 1) as unique_reads,
  round(avg(q) filter (k = 1), 2) as mean_mapped, cast(coalesce(sum(j) filter (k = 1), 0) as bigint) as splices, count(*) filter (k in (2, 3)) as multi_reads, count(*) filter (k > 3) as many_reads,
  count(*) filter (k = 0) as unmapped, round(100.0 * count(*) filter (k = 1) / count(*), 2) as unique_share, round(100.0 * count(*) filter (k in (2, 3)) / count(*), 2) as multi_share,
  round(100.0 * count(*) filter (k > 3) / count(*), 2) as many_share, round(100.0 * count(*) filter (k = 0) / count(*), 2) as unmapped_share
from (select l_linenumber % 6 as k, cast(floor(l_quantity) as bigint) as q, l_partkey % 3 as j from lineitem)""")
def final_report(spark, d):
    x = V.table(spark, d, "lineitem").select(
        (F.col("l_linenumber") % 6).alias("n_loci"), F.lit(100).alias("read_len"), F.floor("l_quantity").alias("mapped_len"), (F.col("l_partkey") % 3).alias("n_junction")
    )
    return sinks.final_metrics(x, 3)


# From files: the part table is written as annotation and read back.
GTF = """with e as (select 'chr' || (p_partkey % 5) as chr, p_partkey * 50 as s, p_partkey * 50 + p_size * 10 as e, p_size % 2 = 0 as rev, 'G' || (p_partkey // 3) || '_' || (p_size % 2) as gene,
  'T' || (p_partkey // 6) || '_' || (p_size % 2) as tr from part where p_size > 0)"""


def _exons(spark, d):
    x = V.table(spark, d, "part").filter("p_size > 0")
    gene = F.concat(F.lit("G"), F.floor(F.col("p_partkey") / 3).cast("string"), F.lit("_"), (F.col("p_size") % 2).cast("string"))
    transcript = F.concat(F.lit("T"), F.floor(F.col("p_partkey") / 6).cast("string"), F.lit("_"), (F.col("p_size") % 2).cast("string"))
    tags = F.concat(F.lit('gene_id "'), gene, F.lit('"; transcript_id "'), transcript, F.lit('";'))
    at = F.col("p_partkey") * 50
    line = F.concat_ws(
        "\t", F.concat(F.lit("chr"), (F.col("p_partkey") % 5).cast("string")), F.lit("made"), F.lit("exon"), (at + 1).cast("string"), (at + F.col("p_size") * 10).cast("string"),
        F.lit("."), F.when(F.col("p_size") % 2 == 0, "-").otherwise("+"), F.lit("."), tags,
    )
    path = scratch(spark, "gtf")
    x.select(line.alias("value")).write.text(path)
    return D.exon_table(sources.gtf(spark, path))


@query(GTF + """ select gene, chr, min(s) as "start", max(e) as "end" from e group by gene, chr""")
def gtf_genes(spark, d):
    return D.gene_bodies(_exons(spark, d))


@query(GTF + """, m as (select *, coalesce(s > max(e) over (partition by gene, rev, chr order by s, e rows between unbounded preceding and 1 preceding), true) as new from e)
, i as (select *, count(*) filter (new) over (partition by gene, rev, chr order by s, e rows unbounded preceding) as k from m)
select chr, min(s) as r_start, max(e) as r_end, gene, rev as gene_reverse from i group by chr, gene, rev, k""")
def gtf_merged_exons(spark, d):
    return D.merged_exons(_exons(spark, d))


@query(GTF + """, n as (select chr, e + 1 as "start", lead(s + 1) over (partition by tr, chr, rev order by s, e) - 1 as "end", case when rev then '-' else '+' end as strand from e)
select distinct chr, "start", "end", strand from n where "end" > "start" union select 'chr9', 5, 9, '+'""")
def gtf_junctions(spark, d):
    """Introns of the annotation together with a junction list."""
    path = scratch(spark, "junctions")
    spark.createDataFrame([("chr9\t5\t9\t+",), ("chr9\t5\t9\t+",)], "value string").write.text(path)
    return D.annotated_junctions(_exons(spark, d), sources.junction_table(spark, path))


TAGS = """with a as (select distinct l_orderkey as read_id, l_linenumber as line, l_partkey as part, l_suppkey as supp from lineitem)
, t as (select *, part % 7 as m1, supp % 7 as m2, part % 2 = 0 as a1, supp % 3 = 0 as a2, 10 + line as len1, 21 + supp as gap1, 30 as len2, 40 + part % 50 as gap2 from a)"""


@query(TAGS + """ select read_id, line, part, supp, line + part % 3 + 1 + supp % 4 + 1 as nm,
  case when (m1 in (1, 3, 5) or m2 in (1, 3, 5)) and not (m1 in (2, 4, 6) or m2 in (2, 4, 6)) then '+'
    when (m1 in (2, 4, 6) or m2 in (2, 4, 6)) and not (m1 in (1, 3, 5) or m2 in (1, 3, 5)) then '-' end as xs,
  (m1 + case when a1 then 20 else 0 end) || ',' || (m2 + case when a2 then 20 else 0 end) as jm,
  (part * 50 + len1 + 1) || ',' || (part * 50 + len1 + gap1) || ',' || (part * 50 + len1 + gap1 + len2 + (supp % 4 + 1) + 1) || ',' || (part * 50 + len1 + gap1 + len2 + (supp % 4 + 1) + gap2) as ji
from t""")
def record_tags(spark, d):
    from helixframe.operators import tags as R

    part, supp, line = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    cigar = S.parse_cigar(text(10 + line, "M", 21 + supp, "N", part % 3 + 1, "I", F.lit(30), "M", supp % 4 + 1, "D", part % 50 + 40, "N9M"))
    motifs, known = F.array((part % 7).cast("int"), (supp % 7).cast("int")), F.array(part % 2 == 0, supp % 3 == 0)
    joined = lambda a: F.array_join(F.transform(a, lambda x: x.cast("string")), ",")
    rows = V.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").distinct()
    return rows.select(
        F.col("l_orderkey").alias("read_id"), line.alias("line"), part.alias("part"), supp.alias("supp"), R.edit_distance(line, cigar).cast("long").alias("nm"),
        R.transcript_strand(motifs).alias("xs"), joined(R.junction_motifs(motifs, known)).alias("jm"), joined(R.junction_places(part * 50, cigar)).alias("ji"),
    )


RECORDS = """with o as (select o_orderkey as k, o_custkey % 5 as chr, o_custkey % 300 * 37 as p, o_orderkey % 9 as odd, cast(floor(o_totalprice) as bigint) % 50 as score from orders)
, r as (select k * 2 as record, k as name, chr, p as pos, p + 60 + odd % 2 * 40 as mate_pos, case when odd = 4 then 163 else 99 end as flag, case when odd = 7 then 2 else 1 end as n_loci, score, p - odd % 3 as unclip, 50 as cigar from o
  union all select k * 2 + 1, k, chr, p + 60 + odd % 2 * 40, p, case when odd = 4 then 83 else 147 end, case when odd = 7 then 2 else 1 end, score + 1, p + 60 + odd % 2 * 40, 51 from o)
, m as (select *, case when n_loci = 1 and mate_pos > pos then mate_pos end as m from r)"""


@query(RECORDS + """, p as (select *, max(m) over w as past, count(m) over w as g from m window w as (partition by chr order by pos, record rows between unbounded preceding and 1 preceding))
, f as (select *, g > 0 and pos > past as beyond from p)
, n as (select *, beyond and row_number() over (partition by chr, g, beyond order by pos, record) = 1 as new from f)
, c as (select *, 1 + count(*) filter (new) over (partition by chr order by pos, record) as cluster from n)
, u as (select *, flag & 128 > 0 as two from c where n_loci = 1)
, q as (select chr, cluster, name, max(unclip) filter (not two) as u1, max(unclip) filter (two) as u2, max(flag) filter (not two) as f1, max(flag) filter (two) as f2,
  max(cigar) filter (not two) as c1, max(cigar) filter (two) as c2, max(score) filter (not two) as s from u group by chr, cluster, name having count(*) = 2 and count(distinct two) = 2)
, k as (select *, row_number() over (partition by chr, cluster, u1, u2, f1, f2, c1, c2 order by s desc, len(name::varchar), name::varchar) as k from q)
, free as (select record from u join k on k.chr = u.chr and k.cluster = u.cluster and k.name = u.name where k.k = 1)
select record, n_loci = 1 and record not in (select record from free) as duplicate from r""")
def dup_mark_full(spark, d):
    from helixframe.operators import duplicates as Q

    k, p, odd = F.col("o_orderkey"), F.col("o_custkey") % 300 * 37, F.col("o_orderkey") % 9
    other, score = p + 60 + odd % 2 * 40, F.floor("o_totalprice") % 50
    side = lambda record, pos, mate, flag, s, unclip, cigar: F.struct(
        record.alias("record"), pos.alias("pos"), mate.alias("mate_pos"), flag.alias("flag"), s.alias("score"), unclip.alias("unclip"), F.lit(cigar).alias("cigar")
    )
    one = side(k * 2, p, other, F.when(odd == 4, 163).otherwise(99), score, p - odd % 3, 50)
    two = side(k * 2 + 1, other, p, F.when(odd == 4, 83).otherwise(147), score + 1, other, 51)
    rows = V.table(spark, d, "orders").select(
        k.cast("string").alias("name"), (F.col("o_custkey") % 5).alias("chr"), F.when(odd == 7, 2).otherwise(1).alias("n_loci"), F.explode(F.array(one, two)).alias("r")
    )
    rows = rows.select("name", "chr", "n_loci", "r.*", F.lit("").alias("seq"))
    return Q.marked(rows, width=1000).select("record", "duplicate")


@query(with_views("chain") + """, l as (select p_partkey as line_no, p_partkey % 5 as chr, p_partkey * 17 as s, p_partkey * 17 + p_size * 20 as e from part)
, b as (select *, lead(s2) over (partition by chr order by s1) as n2 from chain)
, h as (select chr, arg_min(s2, s1) as s2 from chain group by chr)
, js as (select l.line_no, b.s1, b.s2, b.len, b.n2, row_number() over (partition by l.line_no order by b.s1 desc) as k from l left join b on b.chr = l.chr and b.s1 <= l.s)
, je as (select l.line_no, b.s1, b.s2, b.len, row_number() over (partition by l.line_no order by b.s1 desc) as k from l left join b on b.chr = l.chr and b.s1 <= l.e)
, x as (select l.*, case when js.s1 is not null and l.s < js.s1 + js.len then js.s2 + l.s - js.s1 when js.s1 is null then h.s2 else js.n2 end as ns,
  case when je.s1 is not null and l.e < je.s1 + je.len then je.s2 + l.e - je.s1 when je.s1 is not null then je.s2 + je.len - 1 end as ne
  from l join js on js.line_no = l.line_no and js.k = 1 join je on je.line_no = l.line_no and je.k = 1 left join h on h.chr = l.chr)
select line_no, coalesce(ne >= ns, false) as lifted, case when coalesce(ne >= ns, false) then 'n' || chr || chr(9) || 'a' || chr(9) || 'exon' || chr(9) || ns || chr(9) || ne || chr(9) || '.' || chr(9) || 'id "x"'
  else chr || chr(9) || 'a' || chr(9) || 'exon' || chr(9) || s || chr(9) || e || chr(9) || '.' || chr(9) || 'id "x"' end as value from x""")
def gtf_lift(spark, d):
    c, at = (F.col("p_partkey") % 5).cast("string"), F.col("p_partkey") * 17
    value = F.concat_ws("\t", c, F.lit("a"), F.lit("exon"), at.cast("string"), (at + F.col("p_size") * 20).cast("string"), F.lit("."), F.lit('id "x"'))
    lines = V.table(spark, d, "part").select(F.col("p_partkey").alias("line_no"), value.alias("value"))
    chain = V.chain_blocks(spark, d).withColumn("chr", F.col("chr").cast("string"))
    return A.lift_annotation(lines, chain.withColumn("new_chr", F.concat(F.lit("n"), "chr")))


@query("""with r as (select l_suppkey as cb, l_linenumber = 1 as perfect, l_linenumber = 2 as mm1, l_linenumber = 3 as mmn, l_partkey % 4 = 0 as gu, l_partkey % 4 = 1 as gm, l_returnflag = 'R' as fu,
  l_returnflag = 'A' as fm, l_partkey % 3 = 0 as ex, l_partkey % 3 = 1 as intr, l_orderkey % 5 = 0 as exa, l_orderkey % 5 = 1 as inta, l_suppkey % 7 = 0 as mito, l_partkey % 2 = 0 as cu, l_linenumber > 5 as cm,
  l_partkey % 8 as gene, l_orderkey % 64 as umi from lineitem)
, m as (select cb, count(*) as u, count(distinct gene) as g from (select distinct cb, gene, umi from r where cu) group by cb)
select cb, count(*) as "cbMatch", count(*) filter (perfect) as "cbPerfect", count(*) filter (mm1) as "cbMMunique", count(*) filter (mmn) as "cbMMmultiple", count(*) filter (gu) as "genomeU", count(*) filter (gm) as "genomeM",
  count(*) filter (fu) as "featureU", count(*) filter (fm) as "featureM", count(*) filter (ex) as exonic, count(*) filter (intr) as intronic, count(*) filter (exa) as "exonicAS", count(*) filter (inta) as "intronicAS",
  count(*) filter (mito) as mito, count(*) filter (cu) as "countedU", count(*) filter (cm) as "countedM", coalesce(any_value(u), 0) as "nUMIunique", coalesce(any_value(g), 0) as "nGenesUnique", cast(0 as bigint) as "nUMImulti",
  cast(0 as bigint) as "nGenesMulti" from r left join m using (cb) group by cb""")
def cell_read_table(spark, d):
    from helixframe.operators import cells as C
    from helixframe.operators import molecules as M

    part, line, order, supp = F.col("l_partkey"), F.col("l_linenumber"), F.col("l_orderkey"), F.col("l_suppkey")
    flags = {
        "cbPerfect": line == 1, "cbMMunique": line == 2, "cbMMmultiple": line == 3, "genomeU": part % 4 == 0, "genomeM": part % 4 == 1, "featureU": F.col("l_returnflag") == "R",
        "featureM": F.col("l_returnflag") == "A", "exonic": part % 3 == 0, "intronic": part % 3 == 1, "exonicAS": order % 5 == 0, "intronicAS": order % 5 == 1, "mito": supp % 7 == 0,
        "countedU": part % 2 == 0, "countedM": line > 5,
    }
    x = V.table(spark, d, "lineitem")
    rows = x.select(supp.alias("cb"), *(c.alias(k) for k, c in flags.items()))
    obs = x.filter(flags["countedU"]).select(supp.alias("cb"), (part % 8).alias("gene"), (order % 64).alias("umi"))
    return C.read_table(rows, M.count_exact(M.molecules(obs)))


@query(with_views("sparse") + """, m0 as (select cb, umi, gene, cast(sum(1) as bigint) as reads from sparse group by cb, umi, gene)
, w as (select *, count(*) over (partition by cb, umi) as g, max(reads) over (partition by cb, umi) as x from m0)
, m as (select cb, umi, gene, reads from w where g = 1 or reads >= case when x = 1 then 2 else x end)
, e as (select a.cb, a.gene, a.umi, a.reads, b.umi as other, b.reads as other_reads from m a join m b on a.cb = b.cb and a.gene = b.gene and a.umi <> b.umi
  and bit_count((xor(a.umi, b.umi) | (xor(a.umi, b.umi) >> 1)) & 349525) = 1)
, t as (select cb, gene, umi, arg_max(other, other_reads * 4096 + other) as target from e where (other_reads, other) > (reads, umi) group by cb, gene, umi)
select m.cb, m.gene, count(distinct coalesce(t.target, m.umi)) as value from m left join t on m.cb = t.cb and m.gene = t.gene and m.umi = t.umi group by m.cb, m.gene""")
def matrix_filter_collapse(spark, d):
    """Genes are filtered, then tags collapsed; a third of the observations are ambiguous ones."""
    from helixframe.operators import molecules as M

    obs = V.sparse(spark, d)
    extra = F.col("n") % 3 == 0
    return M.count_matrix(obs.filter(~extra), 5, method="1mm_cr", filtering="multi", ambiguous=obs.filter(extra))


VARIANTS = """with v as (select p_partkey % 5 as chr, p_partkey * 30 as pos, 1 + p_size % 3 as ref_len, repeat('G', 1 + p_size % 4) as alt from part)
, c as (select range as chr, cast((select max(p_partkey) from part) * 30 + 100 as bigint) as length from range(5))
, x as (select chr, pos, pos + ref_len as old_start, len(alt) - ref_len as shift, least(len(alt), ref_len) as kept from v where len(alt) <> ref_len union all select chr, -1, 0, 0, 0 from c)
, y as (select chr, old_start, old_start + sum(shift) over w as new_start, lead(pos + kept) over w as until from x window w as (partition by chr order by pos))"""


@query(VARIANTS + """ select y.chr, old_start, cast(new_start as bigint) as new_start, coalesce(until, length) - old_start as len from y join c on c.chr = y.chr""")
def transform_blocks(spark, d):
    x = V.table(spark, d, "part")
    size = F.col("p_size")
    variants = x.select((F.col("p_partkey") % 5).alias("chr"), (F.col("p_partkey") * 30).alias("pos"), (size % 3 + 1).alias("ref_len"), F.repeat(F.lit("G"), size % 4 + 1).alias("alt"))
    length = x.agg(F.max("p_partkey") * 30 + 100).first()[0]
    chromosomes = spark.range(5).select(F.col("id").alias("chr"), F.lit(length).cast("long").alias("length"))
    return A.transform_blocks(chromosomes, A.substitute_variants(variants))


@query(with_views("obs") + """ select chr, "start", "end", strand, motif, count(*) as n_unique, cast(0 as bigint) as n_multi, max(overhang) as overhang, bool_or(annotated) as annotated
from obs where is_unique group by chr, "start", "end", strand, motif""")
def sj_unique_only(spark, d):
    from helixframe.operators import junctions as J

    return J.collapse(P.unique_only(V.junction_obs(spark, d)))


BEST_PARTNERS = """with s as (select l_orderkey as read_id, l_linenumber * 1000000 + l_partkey as seg, l_suppkey % 3 as chr, min(l_extendedprice::bigint) as "start", l_partkey % 2 = 0 as rev, (l_partkey % 4) * 25 as rs,
  (l_partkey % 4) * 25 + 20 + l_suppkey % 40 as re0, l_partkey % 9 = 0 as plus, l_suppkey % 11 = 0 as minus, l_suppkey % 17 = 0 as other from lineitem group by all)
, t as (select *, least(re0, 100) as re, "start" + least(re0, 100) - rs as "end", least(re0, 100) - rs - l as score, case when rev then 100 - least(re0, 100) else rs end as b, case when rev then 100 - rs else least(re0, 100) end as e,
  count(*) over (partition by read_id) as n from (select *, (seg % 3) as l from s))
, m as (select * from t qualify row_number() over (partition by read_id order by score desc, seg) = 1)
, f as (select m.read_id, m.seg as a, t.seg as b, greatest(0, least(m.e, t.e) - greatest(m.b, t.b)) as ov, m.score + t.score - greatest(0, least(m.e, t.e) - greatest(m.b, t.b)) as score,
  t.b as tb, t.e as te, m.b as mb, m.e as me, m.chr <> t.chr or m.rev <> t.rev or greatest(t."start" - m."end", m."start" - t."end", 0) > 589824 as unlike
  from m join t on m.read_id = t.read_id and m.seg <> t.seg where (m.n <= 10 or m.n = 2) and (m.b >= 12 or m.e - 1 + 12 < 100) and m.e - m.b >= 12 and not m.other and not t.other and not (m.plus and m.minus)
  and (not (m.plus or m.minus) or not (t.plus or t.minus) or (m.rev <> m.plus) = (t.rev <> t.plus)) and least(m.e - m.b, t.e - t.b) > 12 + greatest(0, least(m.e, t.e) - greatest(m.b, t.b)) and m.e >= t.b and t.e >= m.b)
, best as (select * from f qualify row_number() over (partition by read_id order by score desc, b) = 1)
, nx as (select best.read_id, max(f.score) as nx from best join f on best.read_id = f.read_id and f.b <> best.b and greatest(0, least(best.te, f.te) - greatest(best.tb, f.tb)) = 0 group by 1)
select read_id, case when mb <= tb then a else b end as donor, case when mb <= tb then b else a end as acceptor, ov as overlap, score from best left join nx using (read_id)
where score >= 0 and score + 20 >= 100 and (nx is null or nx + 10 < score) and (ov > 0 or least(me - mb, te - tb) >= 20) and unlike"""


@query(BEST_PARTNERS)
def chimeric_best(spark, d):
    """An order's lines as segments of one read: the best pair of each read."""
    c = F.col
    x = V.table(spark, d, "lineitem").groupBy(
        c("l_orderkey").alias("read_id"), (c("l_linenumber") * 1000000 + c("l_partkey")).alias("seg"), (c("l_suppkey") % 3).alias("chr"), (c("l_partkey") % 2 == 0).alias("is_reverse"),
        (c("l_partkey") % 4 * 25).alias("read_start"), F.least(c("l_partkey") % 4 * 25 + 20 + c("l_suppkey") % 40, F.lit(100)).alias("read_end"), (c("l_partkey") % 9 == 0).alias("plus"),
        (c("l_suppkey") % 11 == 0).alias("minus"), (c("l_suppkey") % 17 == 0).alias("other"), (c("l_suppkey") % 40).alias("_more"),
    ).agg(F.min(F.round("l_extendedprice").cast("long")).alias("start"))
    size = c("read_end") - c("read_start")
    x = x.withColumns({"end": c("start") + size, "score": size - c("seg") % 3, "read_len": F.lit(100)})
    return X.best_partners(x).select("read_id", F.col("donor.seg").alias("donor"), F.col("acceptor.seg").alias("acceptor"), "overlap", "score")
