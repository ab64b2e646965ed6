"""Queries on records, mates, transcripts, cells and junction sets."""

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
from helixframe.operators import records as R
from helixframe.operators import transcripts as T
from helixframe.plans import adapters as V
from helixframe.plans.adapters import with_views
from helixframe.plans.queries import COLLAPSE, _dense, _regions
from helixframe.plans.registry import ORACLE_SQL, query


@query(f"select kind, count(*) as n from ({ORACLE_SQL['cb_1mm_match']}) group by kind")
def cb_match_stats(spark, d):
    return B.match_stats(B.correct(V.barcodes(spark, d), V.whitelist(spark, d), size=8))


@query(f"""with r as ({ORACLE_SQL['read_regions']}), b as ({ORACLE_SQL['cb_exact_match']})
select coalesce(cb_idx, -1) as cb, count(*) as reads, count(*) filter (region = 'exonic') as exonic, count(*) filter (region = 'intronic') as intronic,
  count(*) filter (region = 'intergenic') as intergenic, count(*) filter (antisense) as antisense from r left join b using (read_id) group by 1""")
def cell_read_stats(spark, d):
    cbs = B.exact_match(V.barcodes(spark, d), V.whitelist(spark, d)).select("read_id", F.col("cb_idx").alias("cb"))
    return C.read_stats(_regions(spark, d).join(cbs, "read_id", "left"))


@query(f"""with g as ({ORACLE_SQL['gene_concordant']})
select cast(floor(read_id / 10) % 1000 % 96 as bigint) as cell, gene, count(*) as value from g where status = 'gene' group by 1, 2""")
def smartseq_counts(spark, d):
    reads = V.alignments(spark, d)
    genes = G.assign(G.concordant_genes(reads, V.gene_intervals(spark, d), 512), reads)
    return C.read_counts(genes.withColumn("cell", (F.floor(F.col("read_id") / 10) % 1000 % 96).cast("long")))


@query(with_views("dense") + """, c as (select cb, gene, count(distinct umi) as value from dense group by cb, gene)
, s as (select cb, sum(value) as n from c group by cb)
, r as (select cb, row_number() over (order by n desc, cb) as k from s)
select gene, cast(sum(value) as bigint) as value from c join r using (cb) where k between 51 and 90 group by gene""")
def ambient_profile(spark, d):
    counts = M.count_exact(_dense(spark, d))
    return C.ambient(counts, 51, 90)


@query(with_views("dense") + """, c as (select cb, gene, count(distinct umi) as value from dense group by cb, gene)
, s as (select cb, sum(value) as n from c group by cb), k as (select cb, row_number() over (order by cb) as col from (select cb from s order by n desc, cb limit 20))
select gene, col, value from c join k using (cb)""")
def matrix_filtered(spark, d):
    counts = M.count_exact(_dense(spark, d))
    totals = counts.groupBy("cb").agg(F.sum("value").alias("n_umis"))
    return C.filtered_matrix(counts, C.top_cells(totals, 20))


@query(with_views("scored") + """ select read_id, chr, score, min("start") as "start" from scored group by read_id, chr, score""")
def alignment_dedup(spark, d):
    rows = R.distinct_first(V.scored(spark, d), ["read_id", "chr", "score"], ["start", "is_reverse", "n_junction"])
    return rows.select("read_id", "chr", "score", "start")


@query(with_views("scored") + """, r as (select *, row_number() over (partition by read_id order by score desc, n_junction, chr, "start", is_reverse) as hit,
  count(*) over (partition by read_id) as k from scored)
select read_id, cast(hit as integer) as hit, read_id || chr(9) || (case when is_reverse then 16 else 0 end + case when hit > 1 then 256 else 0 end) || chr(9) || 'chr' || r.chr
  || chr(9) || ("start" + 1) || chr(9) || case when k = 1 then 255 when k = 2 then 3 when k <= 4 then 1 else 0 end || chr(9) || '100M' || chr(9) || '*' || chr(9) || '0'
  || chr(9) || '0' || chr(9) || '*' || chr(9) || '*' || chr(9) || 'NH:i:' || k || chr(9) || 'HI:i:' || hit || chr(9) || 'AS:i:' || score || chr(9) || 'nM:i:' || n_mismatch as line
from r""")
def sam_lines(spark, d):
    rows = A.drop_many_loci(V.scored(spark, d), 1000)
    hits = A.ranked(rows).withColumns({
        "chr_name": F.concat(F.lit("chr"), F.col("chr").cast("string")), "cigar": F.concat(F.col("read_len").cast("string"), F.lit("M")),
        "seq": F.lit(None).cast("string"), "qual": F.lit(None).cast("string"),
    })
    return R.sam_lines(hits)


def _mates(spark, d):
    x = V.table(spark, d, "lineitem")
    start = F.col("l_partkey") * 50
    return x.select(
        F.col("l_orderkey").alias("read_id"), (F.col("l_linenumber") % 2 + 1).alias("mate"), (F.col("l_suppkey") % 3).alias("chr"), start.alias("start"),
        (start + F.floor("l_quantity") + 50).alias("end"), (F.col("l_returnflag") == "R").alias("is_reverse"),
    ).distinct()


@query("""with m as (select distinct l_orderkey as read_id, l_linenumber % 2 + 1 as mate, l_suppkey % 3 as chr, l_partkey * 50 as "start",
  l_partkey * 50 + cast(floor(l_quantity) as bigint) + 50 as "end", l_returnflag = 'R' as is_reverse from lineitem)
select a.read_id, a.chr, a."start" as start1, b."start" as start2,
  case when a."start" <= b."start" then 1 else -1 end * (greatest(a."end", b."end") - least(a."start", b."start")) as tlen,
  greatest(a."end", b."end") - least(a."start", b."start") <= 30000 as proper
from m a join m b on a.read_id = b.read_id and a.chr = b.chr and a.mate = 1 and b.mate = 2 and a.is_reverse <> b.is_reverse
where case when a.is_reverse then b."start" else a."start" end < case when a.is_reverse then a."end" else b."end" end
  and greatest(a."start", b."start") - least(a."end", b."end") <= 60000""")
def mate_pairs(spark, d):
    return R.pair_mates(_mates(spark, d), 60_000, 30_000)


@query(with_views("aln") + """, v as (select p_partkey % 5 as chr, p_partkey * 50 + p_size as locus, p_partkey as site from part)
select read_id, v.chr, locus, site, locus - "start" as block_pos from aln join v on aln.chr = v.chr and locus >= "start" and locus < "end" """)
def snv_overlap(spark, d):
    sites = V.table(spark, d, "part").select(
        (F.col("p_partkey") % 5).alias("chr"), (F.col("p_partkey") * 50 + F.col("p_size")).alias("locus"), F.col("p_partkey").alias("site")
    )
    return R.covered_sites(V.alignments(spark, d).select("read_id", "chr", "start", "end"), sites, 512)


@query(with_views("aln") + """, s as (select chr * 2 + case when is_reverse then 1 else 0 end as track, "start" as p, 2520 // n_loci as d from aln where n_loci > 0
  union all select chr * 2 + case when is_reverse then 1 else 0 end, "end", -(2520 // n_loci) from aln where n_loci > 0)
, t as (select track, p, sum(d) as d from s group by track, p having sum(d) <> 0)
, r as (select track, p as "start", lead(p) over (partition by track order by p) as "end", cast(sum(d) over (partition by track order by p) as bigint) as value from t)
select * from r where value <> 0""")
def coverage_weighted(spark, d):
    """Strand by strand, a read of n places counting 2520 / n at each: equal sums are equal integers."""
    rows = V.alignments(spark, d).filter("n_loci > 0").withColumn("track", F.col("chr") * 2 + F.col("is_reverse").cast("int"))
    return I.coverage(rows, chrom="track", weight=F.expr("2520 div n_loci"), width=16_384)


EXONS = """with ex as (select l_orderkey as transcript, l_orderkey % 5 as chr, l_orderkey * 100 + l_linenumber * 1000 as "start",
  l_orderkey * 100 + l_linenumber * 1000 + 300 + max(l_partkey) % 7 as "end" from lineitem group by l_orderkey, l_linenumber)"""
BLOCKS = """, nx as (select *, lead("start") over (partition by transcript order by "start") as next from ex)
, bl as (select transcript * 2 as read_id, 0 as block_no, 1 as n_blocks, chr, max("start") + 5 as "start", max("start") + 60 as "end" from ex group by transcript, chr
  union all select ("start" * 100 + transcript) * 2 + 1, 0, 2, chr, "end" - 40, "end" from nx where next is not null
  union all select ("start" * 100 + transcript) * 2 + 1, 1, 2, chr, next, next + 40 from nx where next is not null)
, o as (select *, row_number() over (partition by transcript order by "start") - 1 as exon_no,
  coalesce(sum("end" - "start") over (partition by transcript order by "start" rows between unbounded preceding and 1 preceding), 0) as off,
  sum("end" - "start") over (partition by transcript) as total from ex)
, h as (select read_id, transcript, n_blocks, exon_no, off + bl."start" - o."start" as a, off + bl."end" - o."start" as b, total
  from bl join o on bl.chr = o.chr and o."start" <= bl."start" and o."end" >= bl."end"
  where (block_no = 0 or bl."start" = o."start") and (block_no = n_blocks - 1 or bl."end" = o."end"))
, cc as (select read_id, transcript, cast(min(a) as bigint) as t_start, cast(max(b) as bigint) as t_end, cast(any_value(total) - max(b) as bigint) as to_end from h
  group by read_id, transcript having count(*) = any_value(n_blocks) and max(exon_no) - min(exon_no) + 1 = any_value(n_blocks))"""


def _exons(spark, d):
    x = V.table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_partkey").alias("p"))
    start = F.col("l_orderkey") * 100 + F.col("l_linenumber") * 1000
    return x.select(F.col("l_orderkey").alias("transcript"), (F.col("l_orderkey") % 5).alias("chr"), start.alias("start"), (start + 300 + F.col("p") % 7).alias("end"))


def _blocks(exons):
    from pyspark.sql import Window

    nxt = exons.withColumn("next", F.lead("start").over(Window.partitionBy("transcript").orderBy("start"))).filter("next is not null")
    name = (F.col("start") * 100 + F.col("transcript")) * 2 + 1
    block = lambda i, n, a, b: [F.lit(i).alias("block_no"), F.lit(n).alias("n_blocks"), "chr", a.alias("start"), b.alias("end")]
    last = exons.groupBy("transcript", "chr").agg(F.max("start").alias("s"))
    one = last.select((F.col("transcript") * 2).alias("read_id"), *block(0, 1, F.col("s") + 5, F.col("s") + 60))
    two = nxt.select(name.alias("read_id"), *block(0, 2, F.col("end") - 40, F.col("end")))
    return one.unionByName(two).unionByName(nxt.select(name.alias("read_id"), *block(1, 2, F.col("next"), F.col("next") + 40)))


@query(EXONS + """, t as (select transcript, chr, min("start") as "start", max("end") as "end", cast(sum("end" - "start") as bigint) as length, count(*) as n_exons from ex
  group by transcript, chr) select *, max("end") over (partition by chr order by "start", "end", transcript rows unbounded preceding) as max_end from t""")
def transcript_spans(spark, d):
    return T.spans(_exons(spark, d))


@query(EXONS + BLOCKS + " select * from cc")
def transcript_concordant(spark, d):
    exons = _exons(spark, d)
    return T.concordant(_blocks(exons), exons, 512)


@query(EXONS + BLOCKS + """, g as (select to_end as bin, count(*) as n from cc where to_end < 10000 group by to_end)
select bin, n, round(sum(n) over (order by bin range between 50 preceding and 50 following) / least(101, bin + 50), 6) as mean from g""")
def distance_smoothed(spark, d):
    exons = _exons(spark, d)
    rows = T.smoothed(T.distance_histogram(T.concordant(_blocks(exons), exons, 512)))
    return rows.withColumn("mean", F.round("mean", 6))


SETS = """with h as (select l_suppkey % 10 as cluster, l_orderkey % 500 as umi, l_orderkey * 8 + l_linenumber as read_id, p as transcript, l_linenumber as log_weight
  from lineitem, unnest([l_partkey % 3, 3 + l_partkey % 2, 5]) as t(p))
, e as (select cluster, umi, transcript, count(distinct read_id) as k, sum(log_weight) as w from h group by cluster, umi, transcript)
, n as (select cluster, umi, count(distinct read_id) as n from h group by cluster, umi)"""


def _hits(spark, d):
    x = V.table(spark, d, "lineitem")
    p = F.explode(F.array(F.col("l_partkey") % 3, F.col("l_partkey") % 2 + 3, F.lit(5).cast("long")))
    return x.select(
        (F.col("l_suppkey") % 10).alias("cluster"), (F.col("l_orderkey") % 500).alias("umi"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("read_id"),
        p.alias("transcript"), F.col("l_linenumber").alias("log_weight"),
    )


@query(SETS + " select cluster, umi, transcript, cast(w as bigint) as log_weight from e join n using (cluster, umi) where k = n")
def transcript_intersection(spark, d):
    return T.common_transcripts(_hits(spark, d))


@query()
def transcript_em(spark, d):
    return T.transcript_shares(T.common_transcripts(_hits(spark, d))).withColumn("value", F.round("value", 3))


DB = ', db as (select distinct chr, "start", "end", strand from c where annotated)'


@query(with_views("obs") + COLLAPSE + DB + """, nw as (select distinct chr, "start", "end", strand from c where not annotated and (overhang >= 5 or n_unique + n_multi >= 3) and "end" - "start" + 1 <= 589824)
select *, true as annotated from db where not exists (select 1 from nw where nw.chr = db.chr and nw."start" = db."start" and nw."end" = db."end" and nw.strand = db.strand)
union all select *, false from nw""")
def sj_insert(spark, d):
    rows = J.collapse(V.junction_obs(spark, d))
    keys = ["chr", "start", "end", "strand"]
    return J.inserted(rows.filter("annotated").select(*keys), J.novel(rows).select(*keys))


@query(with_views("obs") + COLLAPSE + DB + """ select read_id, obs.chr, obs."start", obs."end", bool_or(db.chr is not null) as known from obs
left join db on db.chr = obs.chr and db."start" = obs."start" and db."end" = obs."end" and db.strand = obs.strand group by read_id, obs.chr, obs."start", obs."end" """)
def sj_annotate(spark, d):
    obs = V.junction_obs(spark, d)
    db = J.collapse(obs).filter("annotated").select("chr", "start", "end", "strand")
    return J.annotated(obs, db)


@query(with_views("seqs") + """, m as (select doc_id, substr(seq, 1, 2) || substr(seq, len(seq) - 1, 2) as m from seqs where len(seq) >= 4)
select doc_id, case m when 'GTAG' then 1 when 'CTAC' then 2 when 'GCAG' then 3 when 'CTGC' then 4 when 'ATAC' then 5 when 'GTAT' then 6 else 0 end as motif from m""")
def splice_motif(spark, d):
    rows = V.sequences(spark, d).filter(F.length("seq") >= 4)
    return rows.select("doc_id", S.splice_motif(F.left("seq", F.lit(2)), F.right("seq", F.lit(2))).alias("motif"))


@query()
def adapter_clip(spark, d):
    seqs = V.sequences(spark, d)
    return seqs.select("doc_id", S.adapter_offset(F.col("seq"), "AGATCGGAAGAGC", 0.1).alias("clip_at"), F.length("seq").alias("n"))


@query(with_views("seqs") + """, l as (select doc_id, seq, len(seq) - len(rtrim(seq, 'A')) as tail,
  list_count(list_transform(range(30), lambda i: case when substr(seq, i + 1, 1) = substr('AAGCAGTGGTATCAACGCAGAGTACATGGG', i + 1, 1) then null else 1 end)) as mism from seqs)
, f as (select doc_id, len(seq) as n, tail, case when len(seq) >= 30 and mism <= 3 then 30 else 0 end as five from l)
select doc_id, five, case when least(tail, n - five) >= 8 then least(tail, n - five) else 0 end as three from f""")
def tso_clip(spark, d):
    five, three = S.primer_clips(F.col("seq"))
    return V.sequences(spark, d).select("doc_id", five.alias("five"), three.alias("three"))
