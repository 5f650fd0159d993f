"""Registered queries of alignments, barcodes, classes, tables and rows, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import proxies as px
from .functions import cigar, clip, sequence
from .operators import alignments as al
from .operators import barcodes as bc
from .operators import junctions as sj
from .operators import cells, chimeras, genomes, mapping, quant, reports, scoring, transcripts, umi
from .options import EmptyDrops
from .registry import _SJ, _pairs, query
from .sources import sinks


def _t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- classes of reads ------------------------------------------------------------------------------------------------

_READ = "l_orderkey * 1000000000 + l_partkey * 10000 + l_suppkey * 10 + l_linenumber"
_KIND = f"select distinct {_READ} read_id, l_partkey transcript, l_linenumber % 5 kind, l_suppkey % 40 off_ from lineitem"


@query(f"""with k as ({_KIND}), s as (select *, read_id % 2 = transcript % 2 sense from k)
  select read_id, case when kind < 2 then 'exonic' when kind = 2 then 'half_exonic' else 'intronic' end || case when sense then '' else '_antisense' end as class, (case when sense then 1 else 0 end)::int n_genes from s""")
def overlap_classes(spark, sf_dir):
    reads, exons = px.spliced_reads(spark, sf_dir)
    numbered = F.transform("blocks", lambda b, i: F.struct(i.cast("int").alias("block"), b["start"].alias("start"), b["end"].alias("end"), (i > 0).alias("joined")))
    alignments = reads.select("read_id", "chr", (1 + F.col("read_id") % 2).cast("int").alias("strand"), numbered.alias("blocks"))
    found = quant.overlap_classes_of(alignments, exons.withColumn("strand", (1 + F.col("transcript") % 2).cast("int")).withColumn("gene", F.expr("transcript div 2")))
    return found.select("read_id", "class", F.size("genes").alias("n_genes"))


@query(f"""with k as ({_KIND}) select read_id, transcript, (case when kind <= 2 then 1 when kind = 3 and off_ < 14 then 8 else 2 end)::int kind from k""")
def flank_concordance(spark, sf_dir):
    reads, exons = px.spliced_reads(spark, sf_dir)
    return transcripts.flank_concordance(reads, exons.withColumn("gene", F.col("transcript")), distinct=True).select("read_id", "transcript", "kind")


# --- barcodes --------------------------------------------------------------------------------------------------------

_CODES = "b as (select distinct (s_suppkey * 37) % 65536 code from supplier)"
_STRING = "list_aggregate(list_transform(range(0, 8), lambda i: substr('ACGT', (({} >> (14 - 2 * i)::int) & 3)::int + 1, 1)), 'string_agg', '')"


def _unknown(spark, sf_dir):
    orders, known = _t(spark, sf_dir, "orders"), px.barcodes(spark, sf_dir)[0]
    seq = sequence.decode((F.col("o_orderkey") * 37) % 65_536, 8)
    at = (F.col("o_orderkey") % 8).cast("int")
    return orders.select(F.col("o_orderkey").alias("read_id"), F.concat(F.substring(seq, F.lit(1), at), F.lit("N"), F.substring(seq, at + 2, F.lit(8))).alias("cb")), known


@query(f"""with {_CODES}, r as (select o_orderkey read_id, (o_orderkey * 37) % 65536 code, (14 - 2 * (o_orderkey % 8))::int s from orders),
  c as (select read_id, (xor(code, code & (3::bigint << s)) | (x::bigint << s)) code, s from r, (select unnest([0, 1, 2, 3]) x)), h as (select read_id, code, s, count(*) over (partition by read_id) k from c join b using (code))
  select read_id, code as match, 2 kind, (7 - s // 2)::int base from h where k = 1""")
def barcode_unknown_base(spark, sf_dir):
    reads, known = _unknown(spark, sf_dir)
    return bc.unknown_base(reads, known, 8)


@query(f"""with {_CODES}, n as (select code match, {_STRING.format('code')} s from b), d as (select match, substr(s, 1, d) || substr(s, d + 2) s from n, (select unnest(range(0, 8)) d)),
  x as (select distinct match, substr(s, 1, i) || c || substr(s, i + 1) s from d, (select unnest(range(0, 8)) i), (select unnest(['A', 'C', 'G', 'T']) c)),
  e as (select match, list_sum(list_transform(range(1, 9), lambda i: (strpos('ACGT', substr(s, i, 1)) - 1)::bigint << (16 - 2 * i)::int))::bigint edited from x),
  f as (select (v::bigint << (2 * i)::int) m from (select unnest(range(0, 8)) i), (select unnest([1, 2, 3]) v)), e1 as (select distinct xor(code, m) edited, code match from b, f), e2 as (select distinct xor(edited, m) edited, match from e1, f),
  u as (select edited, match, min(distance) distance from (select code edited, code match, 0 distance from b union all select edited, match, 1 from e1 union all select edited, match, 2 from e2 union all select edited, match, 2 from e) group by all),
  w as (select *, min(distance) over (partition by edited) low from u), z as (select *, count(*) over (partition by edited) k from w where distance = low)
  select edited, match, distance from z where k = 1""")
def barcode_indel_whitelist(spark, sf_dir):
    return bc.edited_whitelist(px.barcodes(spark, sf_dir)[0], 8, indels=True)


@query(f"""with {_CODES}, q as (select l_orderkey * 10000000 + l_partkey * 10 + l_linenumber k, case when l_orderkey % 3 = 0 then xor((l_suppkey * 37) % 65536, 1::bigint << (2 * (l_orderkey % 8))::int) else (l_suppkey * 37) % 65536 end code from lineitem group by all), r as (select k || ':' || code read_id, code from q),
  f as (select (v::bigint << (2 * i)::int) m from (select unnest(range(0, 8)) i), (select unnest([1, 2, 3]) v)), x as (select read_id, code match from r join b using (code)),
  y as (select read_id, xor(r.code, m) match from r, f where read_id not in (select read_id from x)), z as (select read_id, match, count(*) over (partition by read_id) k from y join b on b.code = y.match)
  , o as (select code match from r join b using (code) group by code)
  select read_id, match from x union all select read_id, match from z where k = 1 and match in (select match from o)""")
def barcode_match_mode(spark, sf_dir):
    known, reads = px.barcodes(spark, sf_dir)
    return bc.match(reads.select(F.concat_ws(":", "read_id", "code").alias("read_id"), sequence.decode(F.col("code"), 8).alias("cb"), F.lit("IIIIIIII").alias("qual")), known, 8, "1MM")


# --- mapping ---------------------------------------------------------------------------------------------------------


@query("""select o_orderkey read_id, 'c' || (o_custkey % 20) chr, (1 + o_orderkey % 2)::int strand, 58 score, 1 n_mm, 1 n_blocks, (o_orderkey % 1900)::bigint g_start from orders""")
def mapped_reads(spark, sf_dir):
    letters = F.translate(F.md5(F.concat(F.col("c").cast("string"), F.lit("-"), F.col("i").cast("string"))), "0123456789abcdef", "ACGTACGTACGTACGT")
    parts = spark.range(20).select(F.col("id").alias("c"), F.explode(F.sequence(F.lit(0), F.lit(63))).alias("i")).select("c", F.struct("i", letters.alias("s")).alias("p"))
    genome = parts.groupBy("c").agg(F.array_join(F.transform(F.sort_array(F.collect_list("p")), lambda p: p["s"]), "").alias("seq")).select(F.concat(F.lit("c"), F.col("c")).alias("chr"), "seq")
    reads = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("read_id"), F.concat(F.lit("c"), F.col("o_custkey") % 20).alias("chr"), (F.col("o_orderkey") % 1900).cast("int").alias("at")).join(F.broadcast(genome), "chr")
    cut = F.substring("seq", F.col("at") + 1, F.lit(60))
    changed = F.concat(F.substring(cut, 1, 30), F.translate(F.substring(cut, 31, 1), "ACGT", "CGTA"), F.substring(cut, 32, 29))
    seq = F.when(F.col("read_id") % 2 == 1, sequence.reverse_complement(changed)).otherwise(changed)
    found = mapping.align(reads.select("read_id", seq.alias("seq")), genome, read_max=100, tile=512)
    best = al.select_multi(found.where("score >= 40"))
    return best.select("read_id", "chr", "strand", "score", "n_mm", F.size("blocks").alias("n_blocks"), F.col("blocks")[0]["g"].alias("g_start"))


@query("""with a as (select l_orderkey * 10 + l_linenumber read_id, l_quantity::int a, l_partkey % 30 b, (l_suppkey % 8)::int k, l_linenumber % 2 ann from lineitem)
  select read_id, a, b, k from a where not (k < 7 and (a < case when ann = 1 then 3 else 5 end or b < case when ann = 1 then 3 else 5 end)) and not (k = 0 and ann = 0)""")
def alignment_final_filter(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem")
    a, b, k = F.col("l_quantity").cast("int"), (F.col("l_partkey") % 30), (F.col("l_suppkey") % 8).cast("int")
    block = lambda g, n: F.struct(F.lit(0).alias("r"), F.lit(g).cast("long").alias("g"), n.cast("int").alias("len"))
    gap = F.struct(F.when(k == 7, -1).otherwise(k).alias("kind"), F.lit(100).cast("long").alias("len"), (F.col("l_linenumber") % 2).cast("int").alias("annot"))
    rows = li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("read_id"), a.alias("a"), b.alias("b"), k.alias("k"), F.array(block(0, a), block(500, b)).alias("blocks"), F.array(gap).alias("gaps"))
    return mapping.final_filter(rows, keep_noncanonical=False).select("read_id", "a", "b", "k")


# --- alignments ------------------------------------------------------------------------------------------------------


@query("with a as (select l_orderkey read_id, l_linenumber i, l_suppkey % 5 chr from lineitem), m as (select *, bool_and(chr < 3) over (partition by read_id) k from a) select read_id, i, chr from m where k")
def reads_on_added_references(spark, sf_dir):
    rows = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("read_id"), F.col("l_linenumber").alias("i"), (F.col("l_suppkey") % 5).alias("chr"))
    return al.keep_references(rows, spark.range(3).withColumnRenamed("id", "chr"))


@query("select l_orderkey read_id, l_linenumber i, ((l_partkey % 4096) | 4) & 1023 flag from lineitem where (l_partkey % 4096) & 1024 = 0 and l_suppkey % 3 > 0 and l_returnflag = 'A'")
def signal_flags(spark, sf_dir):
    rows = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("read_id"), F.col("l_linenumber").alias("i"), (F.col("l_partkey") % 4096).alias("flag"), (F.col("l_suppkey") % 3).alias("nh"), F.concat("l_returnflag", "l_linestatus").alias("chr"))
    return al.signal_reads(rows, "A").select("read_id", "i", al.mask_flags(F.col("flag"), 4, 1023).alias("flag"))


@query("with a as (select distinct l_orderkey read_id, l_partkey % 3 chr, l_suppkey % 2 strand, l_quantity score from lineitem) select read_id, chr, strand, max(score) score from a group by all")
def haplotype_alignments(spark, sf_dir):
    rows = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("read_id"), (F.col("l_partkey") % 3).alias("chr"), (F.col("l_suppkey") % 2).alias("strand"), F.col("l_quantity").alias("score"), F.col("l_linenumber").alias("align_idx"), F.array(F.lit(1)).alias("blocks"))
    return al.distinct_alignments(rows).select("read_id", "chr", "strand", "score")


@query("select l_orderkey read_id, l_linenumber i, coalesce(c.cb, '-') cb, coalesce(c.umi, '-') umi from lineitem left join (select o_orderkey, (o_custkey % 50)::varchar cb, (o_orderkey % 1024)::varchar umi from orders where o_orderkey % 4 > 0) c on l_orderkey = o_orderkey")
def corrected_tags(spark, sf_dir):
    fixed = _t(spark, sf_dir, "orders").where("o_orderkey % 4 > 0").select(F.col("o_orderkey").alias("read_id"), (F.col("o_custkey") % 50).alias("cb"), (F.col("o_orderkey") % 1024).alias("umi"))
    return al.with_corrected(_t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("read_id"), F.col("l_linenumber").alias("i")), fixed)


@query("select l_orderkey * 10 + l_linenumber name, l_suppkey % 7 chr, l_partkey pos from lineitem")
def coordinate_sorted(spark, sf_dir):
    rows = _t(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("name"), (F.col("l_suppkey") % 7).alias("chr"), F.col("l_partkey").alias("pos"), F.col("l_orderkey").alias("read_id"))
    return al.coordinate_sort(rows).drop("read_id")


@query("""with a as (select l_orderkey * 10 + l_linenumber id, l_quantity::int n, l_partkey % 10 m, 1 + l_suppkey % 7 k from lineitem)
  select id, (n - m + case k when 1 then -2 - 2 * 5 when 2 then -2 - 2 * 3 when 3 then -8 when 4 then 0 when 5 then -4 when 6 then -8 else 2 end)::int score, n::int n_match, m::int n_mm, n || repeat('A0', 0) || (select string_agg('C' || '0', '') from range(0, m::int)) md0 from a where m > 0
  union all select id, (n + case k when 1 then -12 when 2 then -8 when 3 then -8 when 4 then 0 when 5 then -4 when 6 then -8 else 2 end)::int, n::int, 0, n::varchar from a where m = 0""")
def alignment_scores(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem")
    n, m, k = F.col("l_quantity").cast("int"), (F.col("l_partkey") % 10).cast("int"), (1 + F.col("l_suppkey") % 7).cast("int")
    kind = F.element_at(F.array(*(F.lit(x) for x in (-1, -2, 0, 1, 3, 5, 4))), k)
    length = F.when(k == 1, 5).when(k == 2, 3).otherwise(100)
    rows = li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.concat(F.repeat(F.lit("G"), n), F.repeat(F.lit("A"), m)).alias("read_bases"), F.concat(F.repeat(F.lit("G"), n), F.repeat(F.lit("C"), m)).alias("genome_bases"), F.array(F.struct(kind.alias("kind"), length.alias("len"), (k == 7).cast("int").alias("annot"))).alias("gaps"), F.lit(1).alias("span"))
    return scoring.score(rows, scoring.Scores(length_scale=0)).select("id", "score", "n_match", "n_mm", scoring.md_tag(F.col("read_bases"), F.col("genome_bases")).alias("md0"))


# --- sequence expressions --------------------------------------------------------------------------------------------

_DNA = "translate(md5(p_partkey::varchar), '0123456789abcdef', 'ACGTACGTACGTACGN')"


@query(f"""with s as (select p_partkey id, {_DNA} q, substr({_DNA}, 3, 6) r from part)
  select id, not contains(r, 'N') and r not in ('AAAAAA', 'CCCCCC', 'GGGGGG', 'TTTTTT') valid, case when contains(r, 'N') then case when len(replace(r, 'N', '')) = 5 then strpos(r, 'N') - 1 else -2 end else -1 end::int unknown,
    list_sum(list_transform(range(1, 7), lambda i: case when substr(q, i, 1) <> substr(r, i, 1) then 1 else 0 end))::int hamming,
    list_min(list_transform(range(0, 27), lambda p: list_sum(list_transform(range(1, 7), lambda i: case when substr('ACNGTN', i, 1) <> 'N' and substr(q, p + i, 1) <> substr('ACNGTN', i, 1) then 1 else 0 end))))::int nearest,
    (case substr(q, 1, 2) || substr(q, 31, 2) when 'GTAG' then 1 when 'CTAC' then 2 when 'GCAG' then 3 when 'CTGC' then 4 when 'ATAC' then 5 when 'GTAT' then 6 else 0 end)::int motif from s""")
def sequence_checks(spark, sf_dir):
    q = F.translate(F.md5(F.col("p_partkey").cast("string")), "0123456789abcdef", "ACGTACGTACGTACGN")
    rows = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), q.alias("q"), F.substring(q, 3, 6).alias("r"))
    motif = sequence.motif(F.substring("q", 1, 2), F.substring("q", 31, 2))
    return rows.select("id", sequence.valid_umi(F.col("r")).alias("valid"), sequence.unknown_position(F.col("r")).cast("int").alias("unknown"), sequence.hamming(F.col("r"), F.col("q")).cast("int").alias("hamming"), sequence.local_hamming(F.col("q"), F.lit("ACNGTN"))["distance"].cast("int").alias("nearest"), motif.cast("int").alias("motif"))


@query("""with r as (select o_orderkey id, o_custkey * 977 b, o_custkey * 977 + 1 + o_orderkey % 100000 e from orders)
  select id, (case when b >> 14 = (e - 1) >> 14 then 4681 + (b >> 14) when b >> 17 = (e - 1) >> 17 then 585 + (b >> 17) when b >> 20 = (e - 1) >> 20 then 73 + (b >> 20) when b >> 23 = (e - 1) >> 23 then 9 + (b >> 23) when b >> 26 = (e - 1) >> 26 then 1 + (b >> 26) else 0 end)::bigint bin from r""")
def region_bins(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") * 977).alias("b"))
    return o.select("id", sequence.region_bin(F.col("b"), F.col("b") + 1 + F.col("id") % 100_000).cast("long").alias("bin"))


@query("select p_partkey id, list_aggregate(list_transform(string_split(p_name, ''), lambda c: chr(least(greatest(ascii(c) - 3, 33), 126))), 'string_agg', '') qual from part")
def quality_clamped(spark, sf_dir):
    return _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), sequence.clamp_quality(F.col("p_name"), shift=-3).alias("qual"))


@query("select p_partkey id, (case when p_size >= 20 then p_size else 0 end)::int tail from part")
def poly_a_tails(spark, sf_dir):
    seq = F.concat(F.lit("CGCGCCTGCG"), F.repeat(F.lit("A"), F.col("p_size")))
    return _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), clip.poly_a_length(seq).alias("tail"))


@query("select p_partkey id, 10 + p_partkey % 13 at_ from part")
def adapter_places(spark, sf_dir):
    body = F.substring(F.repeat(F.lit("C"), 30), F.lit(1), (10 + F.col("p_partkey") % 13).cast("int"))
    return _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), clip.adapter_start(F.concat(body, F.lit("AGATTGGAAGAGT")), "AGATTGGAAGAGT").cast("long").alias("at_"))


@query("select l_orderkey * 10 + l_linenumber id, (case when l_suppkey % 4 > 0 then (l_suppkey % 4) || 'S' else '' end) || l_quantity::int || 'M' || (case when l_partkey % 50 >= 21 then (l_partkey % 50) || 'N' when l_partkey % 50 > 0 then (l_partkey % 50) || 'D' else '' end) || '20M' || (case when l_linenumber > 1 then (l_linenumber - 1) || 'S' else '' end) cigar from lineitem")
def cigar_built(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem")
    lead, n, gap = (F.col("l_suppkey") % 4).cast("int"), F.col("l_quantity").cast("int"), (F.col("l_partkey") % 50).cast("int")
    block = lambda r, g, m: F.struct(r.alias("r"), g.alias("g"), m.alias("len"))
    both = F.array(block(lead, F.lit(100), n), block(lead + n, 100 + n + gap, F.lit(20)))
    return li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), cigar.build(both, lead + n + 20 + F.col("l_linenumber") - 1).alias("cigar"))


# --- tables and rows -------------------------------------------------------------------------------------------------


def _spliced_rows(spark, sf_dir):
    """Alignments with one intron each."""
    li = _t(spark, sf_dir, "lineitem")
    text = F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit("M"), (30 + F.col("l_suppkey") % 5).cast("string"), F.lit("N20M"))
    return li.select(F.col("l_orderkey").alias("read_id"), F.col("l_returnflag").alias("chr"), (F.col("l_partkey") % 100).alias("pos"), text.alias("cigar"), (1 + F.col("l_orderkey") % 3).alias("nh"))


_INTRONS = "i as (select distinct l_orderkey read_id, l_returnflag chr, l_partkey % 100 + l_quantity::int s, l_partkey % 100 + l_quantity::int + 30 + l_suppkey % 5 e, 1 + l_orderkey % 3 nh from lineitem)"


@query(f"with {_INTRONS} select read_id, chr, s as start, e as \"end\" from i")
def junctions_of_reads(spark, sf_dir):
    return reports.junctions_of_alignments(_spliced_rows(spark, sf_dir))


@query(f"with {_INTRONS} select chr, s as start, e as \"end\", count(*) filter (where nh = 1) n_uniq, count(*) filter (where nh > 1) n_multi from i group by all")
def junctions_from_sam(spark, sf_dir):
    return reports.junctions_from_sam(_spliced_rows(spark, sf_dir))


@query("""with e as (select l_orderkey t, l_linestatus chr, l_partkey s, l_partkey + l_quantity::int e from lineitem group by all), x as (select t, chr, list(s order by s, e) ss, list(e order by s, e) ee from e group by all)
  select chr || chr(9) || ss[1] || chr(9) || list_max(ee) || chr(9) || t || chr(9) || '0' || chr(9) || '+' || chr(9) || ss[1] || chr(9) || list_max(ee) || chr(9) || '0' || chr(9) || len(ss) || chr(9)
    || list_aggregate(list_transform(range(1, len(ss) + 1), lambda i: (ee[i] - ss[i])::varchar), 'string_agg', ',') || chr(9) || list_aggregate(list_transform(range(1, len(ss) + 1), lambda i: (ss[i] - ss[1])::varchar), 'string_agg', ',') as value from x""")
def bed_rows(spark, sf_dir):
    ex = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("transcript"), F.col("l_linestatus").alias("chr"), F.col("l_partkey").alias("start"), (F.col("l_partkey") + F.col("l_quantity").cast("int")).alias("end"), F.lit(1).alias("strand")).distinct()
    return reports.bed12(ex)


@query("select p_brand gene, min(p_type) type from part group by p_brand having count(distinct p_type) = 1")
def consistent_types(spark, sf_dir):
    return reports.consistent_types(_t(spark, sf_dir, "part").select(F.col("p_brand").alias("gene"), F.col("p_type").alias("type")))


@query("select l_suppkey cb, l_partkey % 20 gene, count(distinct l_orderkey % 1024) n_umis from lineitem where l_suppkey % 3 > 0 group by all")
def cells_extracted(spark, sf_dir):
    counts = umi.count_exact(umi.molecules(px.solo(spark, sf_dir))).select("cb", "gene", "n_umis")
    return reports.extract_cells(counts, counts.where("cb % 3 > 0").select("cb").distinct())


@query("select l_suppkey::varchar cb, l_partkey % 20 gene, count(distinct l_orderkey % 1024) n_umis from lineitem where l_linenumber > 1 and l_suppkey % 4 > 0 group by all")
def matrix_from_tags(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_orderkey", "l_linenumber")
    cb = F.when(F.col("l_suppkey") % 4 > 0, F.col("l_suppkey").cast("string")).otherwise("-")
    return reports.matrix_from_tags(li.select(cb.alias("cb"), F.when(F.col("l_linenumber") > 1, F.col("l_orderkey") % 1024).alias("umi"), (F.col("l_partkey") % 20).alias("gene")))


@query("select (l_quantity::int + l_partkey % 3000)::bigint size, count(*) n from lineitem where l_quantity::int + l_partkey % 3000 between 1 and 2000 group by 1")
def insert_sizes(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem")
    return reports.insert_sizes(li.select(F.col("l_orderkey").alias("start"), (F.col("l_orderkey") + F.col("l_quantity").cast("int") + F.col("l_partkey") % 3000).alias("end")))


@query("with b as (select l_suppkey t, (l_partkey % 500) * 100 // 500 part from lineitem), n as (select *, count(*) over (partition by t) n from b) select part, round(sum(1.0::double / n), 6) weight from n group by part")
def body_coverage(spark, sf_dir):
    rows = _t(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("transcript"), (F.col("l_partkey") % 500).alias("position"), F.lit(500).alias("length"))
    return reports.gene_body_coverage(rows).withColumn("weight", F.round("weight", 6))


@query("select l_orderkey id, l_linenumber i, case when ((l_partkey % 256) & 16 > 0) <> ((l_partkey % 256) & 128 > 0) then '+' else '-' end xs from lineitem")
def strand_tags(spark, sf_dir):
    rows = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("i"), (F.col("l_partkey") % 256).alias("flag"))
    return reports.strand_tags(rows).select("id", "i", "xs")


@query("select s_suppkey id, case when s_nationkey < 10 then 'S' || (s_nationkey % 2) else 'n' || s_nationkey end chr, s_suppkey + case when s_nationkey < 10 then s_nationkey * 1000 else 0 end as start, s_suppkey + 10 + case when s_nationkey < 10 then s_nationkey * 1000 else 0 end as \"end\" from supplier")
def contigs_shifted(spark, sf_dir):
    rows = _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.concat(F.lit("n"), F.col("s_nationkey")).alias("chr"), F.col("s_suppkey").alias("start"), (F.col("s_suppkey") + 10).alias("end"))
    contigs = _t(spark, sf_dir, "nation").where("n_nationkey < 10").select(F.concat(F.lit("n"), F.col("n_nationkey")).alias("contig"), F.concat(F.lit("S"), F.col("n_nationkey") % 2).alias("super"), (F.col("n_nationkey") * 1000).alias("offset"))
    return reports.shifted_contigs(rows, contigs)


@query("with q as (select p_name a, p_type b from part) select round(sum(len(regexp_replace(a, '[^?-~]', '', 'g')))::double / sum(len(a)), 6) q30_barcode, round(sum(len(regexp_replace(b, '[^?-~]', '', 'g')))::double / sum(len(b)), 6) q30_read from q")
def barcode_quality(spark, sf_dir):
    found = reports.barcode_quality(_t(spark, sf_dir, "part").select(F.col("p_name").alias("cb_qual"), F.col("p_type").alias("qual")))
    return found.select(*(F.round(c, 6).alias(c) for c in found.columns))


@query("select l_suppkey cb, 'c:' || (l_partkey % 50) || ':' || (l_partkey % 50 + 100) junction, count(*) n_reads, count(distinct l_orderkey % 64) n_umis from lineitem where l_linenumber = 1 and l_partkey % 50 < 40 group by all")
def junction_feature_counts(spark, sf_dir):
    li, at = _t(spark, sf_dir, "lineitem"), F.col("l_partkey") % 50
    observed = li.select(F.col("l_suppkey").alias("cb"), (F.col("l_orderkey") % 64).alias("umi"), F.lit("c").alias("chr"), at.alias("start"), (at + 100).alias("end"), F.col("l_linenumber").alias("nh"))
    return reports.junction_feature_counts(observed, spark.range(40).select(F.lit("c").alias("chr"), F.col("id").alias("start"), (F.col("id") + 100).alias("end")))


@query("""with s as (select l_orderkey read_id, l_partkey * 100 + l_linenumber idx, max(l_quantity)::int score, max(l_suppkey) g from lineitem group by all), m as (select *, row_number() over (partition by read_id order by idx) = 1 main from s),
  p as (select a.read_id, a.idx i, b.idx j, a.score + b.score c, abs(a.g - b.g) * 100000 > 1000000 far from m a join m b on a.read_id = b.read_id and a.main and not b.main),
  r as (select *, row_number() over (partition by read_id order by c desc, j) r, lead(c) over (partition by read_id order by c desc, j) n from p) select read_id, i, j, c chim_score from r where r = 1 and far and (n is null or c - n > 10)""")
def chimeric_best_and_next(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("read_id"), (F.col("l_partkey") * 100 + F.col("l_linenumber")).alias("idx")).agg(F.max("l_quantity").cast("int").alias("score"), (F.max("l_suppkey") * 100_000).alias("g_start"))
    first = F.row_number().over(px.Window.partitionBy("read_id").orderBy("idx")) == 1
    rows = li.withColumn("main", first).withColumn("r_start", F.when(F.col("main"), 0).otherwise(60)).withColumn("r_end", F.col("r_start") + F.col("score")).withColumn("chr", F.lit("c")).withColumn("strand", F.lit(0))
    return chimeras.best_and_next(rows)


@query("""with j as (select l_orderkey * 10 + l_linenumber name, l_partkey % 10 chr, l_partkey % 10 + case when l_suppkey % 5 = 0 then 1 else 0 end chr2, (l_linenumber % 3)::int motif, 1000 + l_suppkey % 7 * 10 lo, 3000 + l_partkey % 5 * 10 hi from lineitem)
  select chr, lo as start, hi as "end", '+' strand, count(distinct name) n_reads from j where chr = chr2 and motif > 0 group by all having count(distinct name) >= 2""")
def circular_junctions(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem")
    low, high = 1000 + F.col("l_suppkey") % 7 * 10, 3000 + F.col("l_partkey") % 5 * 10
    rows = li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("name"), (F.col("l_partkey") % 10).alias("chr_donor"), (F.col("l_partkey") % 10 + (F.col("l_suppkey") % 5 == 0).cast("int")).alias("chr_acceptor"), F.lit("+").alias("strand_donor"), F.lit("+").alias("strand_acceptor"), (F.col("l_linenumber") % 3).alias("motif"), high.alias("first_donor"), low.alias("first_acceptor"), (high - 40).alias("start_1"), F.lit("40M").alias("cigar_1"), (low + 1).alias("start_2"), F.lit("30M").alias("cigar_2"))
    return chimeras.circular(rows, least_reads=2)


@query("""with {0} select chr || chr(9) || (start_ + 1) || chr(9) || end_ || chr(9) || strand || chr(9) || motif || chr(9) || annot || chr(9) || n_uniq || chr(9) || n_multi || chr(9) || over_left as value from co""".format(_SJ))
def junction_rows(spark, sf_dir):
    return sinks.junction_rows(sj.collapse(sj.per_read(px.junctions(spark, sf_dir))))


@query("""select (l_orderkey * 10 + l_linenumber) || chr(9) || l_partkey % 256 || chr(9) || l_returnflag || chr(9) || (l_partkey + 1) || chr(9) || case l_linenumber when 1 then 255 when 2 then 3 when 3 then 1 when 4 then 1 else 0 end || chr(9) || l_quantity::int || 'M' || chr(9) ||
  case when l_suppkey % 3 = 0 then '*' when l_suppkey % 3 = 1 then '=' else 'Z' end || chr(9) || case when l_suppkey % 3 = 0 then 0 else l_partkey + 101 end || chr(9) || case when l_suppkey % 3 = 0 then 0 else 150 end || chr(9) || 'ACGT' || chr(9) || 'IIII' || chr(9) ||
  'NH:i:' || l_linenumber || chr(9) || 'HI:i:1' || chr(9) || 'AS:i:' || l_quantity::int || chr(9) || 'nM:i:' || l_partkey % 3 || chr(9) || 'NM:i:0' || chr(9) || 'MD:Z:4' || chr(9) || 'jM:B:c,1' || chr(9) || 'jI:B:i,' || (l_partkey + 11) || ',' || (l_partkey + 40) || case when l_linenumber = 2 then chr(9) || 'XS:A:+' else '' end as value from lineitem""")
def sam_rows(spark, sf_dir):
    li, c = _t(spark, sf_dir, "lineitem"), F.col
    mate = c("l_suppkey") % 3
    return sinks.tagged_sam_rows(li.select(
        (c("l_orderkey") * 10 + c("l_linenumber")).alias("name"), (c("l_partkey") % 256).alias("flag"), c("l_returnflag").alias("chr"), c("l_partkey").alias("pos"), c("l_linenumber").alias("nh"), F.lit(1).alias("hit"), F.concat(c("l_quantity").cast("int").cast("string"), F.lit("M")).alias("cigar"),
        F.when(mate == 1, c("l_returnflag")).when(mate == 2, F.lit("Z")).alias("mate_chr"), F.when(mate > 0, c("l_partkey") + 100).alias("mate_pos"), F.when(mate > 0, 150).alias("tlen"), F.lit("ACGT").alias("seq"), F.lit("IIII").alias("qual"), c("l_quantity").cast("int").alias("score"), (c("l_partkey") % 3).alias("nm"), F.lit(0).alias("edit"), F.lit("4").alias("md"),
        F.array(F.lit(1)).alias("motifs"), F.array(F.struct((c("l_partkey") + 10).alias("start"), (c("l_partkey") + 40).alias("end"))).alias("introns"), F.when(c("l_linenumber") == 2, "+").alias("xs"), F.lit(None).cast("string").alias("mate_cigar"), F.lit(None).cast("string").alias("group"),
    ))


@query("select '@' || o_orderkey || ' ' || (o_custkey % 2) || ':N: ' || (o_custkey % 3 = 0)::int || (o_custkey % 5 = 0)::int || chr(10) || o_orderstatus || chr(10) || '+' || chr(10) || o_orderpriority as value from orders")
def unmapped_rows(spark, sf_dir):
    o, c = _t(spark, sf_dir, "orders"), F.col
    return al.unmapped_rows(o.select(c("o_orderkey").alias("name"), (1 + c("o_custkey") % 2).alias("mate"), c("o_orderstatus").alias("seq"), c("o_orderpriority").alias("qual"), (c("o_custkey") % 3 == 0).alias("mapped1"), (c("o_custkey") % 5 == 0).alias("mapped2")))


@query("select round(1e6::double / count(*) filter (where nh = 1), 6) \"unique\", round(1e6::double / sum(1.0::double / nh), 6) \"all\" from (select 1 + l_orderkey % 4 nh from lineitem)")
def signal_scales(spark, sf_dir):
    found = sinks.signal_scales(_t(spark, sf_dir, "lineitem").select((1 + F.col("l_orderkey") % 4).alias("nh")))
    return found.select(*(F.round(c, 6).alias(c) for c in found.columns))


@query()
def cells_empty_drops(spark, sf_dir):
    counts = umi.count_exact(umi.molecules(px.solo(spark, sf_dir))).select("cb", "gene", "n_umis")
    return cells.call_cells(counts, "EmptyDrops_CR", drops=EmptyDrops(ambient_from=20, ambient_to=60, umi_min=1, simulations=500))


# --- genomes, two passes, sources of junctions -----------------------------------------------------------------------


def _letters(spark, chromosomes: int, parts: int):
    """Chromosomes of letters that MD5 digests spell."""
    letters = F.translate(F.md5(F.concat(F.col("c").cast("string"), F.lit("-"), F.col("i").cast("string"))), "0123456789abcdef", "ACGTACGTACGTACGT")
    each = spark.range(chromosomes).select(F.col("id").alias("c"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("i")).select("c", F.struct("i", letters.alias("s")).alias("p"))
    return each.groupBy("c").agg(F.array_join(F.transform(F.sort_array(F.collect_list("p")), lambda p: p["s"]), "").alias("seq")).select(F.concat(F.lit("c"), F.col("c")).alias("chr"), "seq")


_GENOME = "g as (select 'c' || c chr, string_agg(translate(md5(c::varchar || '-' || i::varchar), '0123456789abcdef', 'ACGTACGTACGTACGT'), '' order by i) seq from (select unnest(range(0, 5)) c), (select unnest(range(0, 32)) i) group by c)"


@query(f"""with {_GENOME}, n as (select distinct 'c' || (n_nationkey % 5) chr, 100 + n_nationkey * 30 pos from nation), v as (select n.chr, pos, substr(seq, pos + 1, 1 + pos % 3) ref, substr('ACGTACGT', 1 + pos % 4, 1 + pos % 4) alt from n join g using (chr)),
  p as (select *, coalesce(lag(pos + len(ref)) over (partition by chr order by pos), 0) b from v)
  select g.chr || '_x' chr, string_agg(substr(seq, b + 1, pos - b) || alt, '' order by pos) || substr(any_value(seq), max(pos + len(ref)) + 1) seq from p join g using (chr) group by g.chr""")
def genome_with_variants(spark, sf_dir):
    genome = _letters(spark, 5, 32)
    pos = 100 + F.col("n_nationkey") * 30
    rows = _t(spark, sf_dir, "nation").select(F.concat(F.lit("c"), F.col("n_nationkey") % 5).alias("chr"), pos.alias("pos")).join(genome, "chr")
    variants = rows.select("chr", "pos", F.substring("seq", F.col("pos") + 1, 1 + F.col("pos") % 3).alias("ref"), F.substring(F.lit("ACGTACGT"), 1 + F.col("pos") % 4, 1 + F.col("pos") % 4).alias("alt"))
    return genomes.with_variants(genome, variants, "_x")[0]


@query("""with a as (select concat_ws(':', l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity::int) read_id, l_quantity::int n, l_partkey % 50 s, (l_suppkey % 4)::int k, l_linenumber % 2 ann from lineitem)
  select read_id from a where not (k < 3 and ann = 0 and (s + n) % 3 <> 0)""")
def alignments_in_table(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem")
    n, s, k = F.col("l_quantity").cast("int"), F.col("l_partkey") % 50, (F.col("l_suppkey") % 4).cast("int")
    block = lambda g, m: F.struct(F.lit(0).alias("r"), g.cast("long").alias("g"), m.cast("int").alias("len"))
    gap = F.struct(F.when(k == 3, -1).otherwise(k).alias("kind"), F.lit(500).cast("long").alias("len"), (F.col("l_linenumber") % 2).cast("int").alias("annot"))
    rows = li.select(F.concat_ws(":", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", n.cast("string")).alias("read_id"), F.lit(0).alias("align_idx"), F.lit("c").alias("chr"), F.array(block(s, n), block(s + n + 500, n)).alias("blocks"), F.array(gap).alias("gaps"))
    table = spark.range(0, 300, 3).select(F.lit("c").alias("chr"), F.col("id").alias("start"), (F.col("id") + 500).alias("end"))
    return mapping.in_table(rows, table).select("read_id")


@query("""with u as (select p_partkey % 97 s, p_size % 3 motif, (p_partkey % 5)::int shift, (p_partkey % 3)::int strand, case p_size % 4 when 0 then 0 when 1 then 10 when 2 then 20 else 30 end priority from part),
  r as (select *, row_number() over (partition by s order by priority desc, (motif > 0)::int desc, shift, strand) k from u) select 'c' chr, s as start, s + 50 as "end", priority, (motif > 0)::int canonical, shift, strand from r where k = 1""")
def junction_sources(spark, sf_dir):
    part, s = _t(spark, sf_dir, "part"), F.col("p_partkey") % 97
    rows = part.select(F.col("p_size"), F.lit("c").alias("chr"), s.alias("start"), (s + 50).alias("end"), (F.col("p_size") % 3).alias("motif"), (F.col("p_partkey") % 5).cast("int").alias("shift"), (F.col("p_partkey") % 3).cast("int").alias("strand"))
    found = sj.union_sources(**{name: rows.where(F.col("p_size") % 4 == i) for i, name in enumerate(("novel", "file", "gtf", "saved"))})
    return found.select("chr", "start", "end", "priority", (F.col("motif") > 0).cast("int").alias("canonical"), "shift", "strand")


@query("""with u as (select p_partkey // 5 s, (p_size // 9 % 3)::int shift, (p_partkey % 3)::int strand, greatest((p_size % 9)::int - 2, 0) motif, case when p_partkey // 3 % 3 = 0 then 20 else 10 end priority from part),
  a as (select *, row_number() over (partition by s - shift, strand order by priority desc, motif > 0 desc, shift, motif) k from u),
  b as (select *, case when motif > 0 then s else s - shift end pos from a where k = 1),
  c as (select *, row_number() over (partition by pos, strand order by priority desc, motif > 0 desc, shift, motif, s) j from b),
  p as (select * from c where j = 1 and strand = 1), m as (select * from c where j = 1 and strand = 2), d as (select * from c where j = 1 and strand = 0),
  two as (select coalesce(p.pos, m.pos) pos, case when p.pos is null then 'm' when m.pos is null then 'p' when p.priority <> m.priority then case when p.priority > m.priority then 'p' else 'm' end
    when m.motif = 0 then case when p.motif = 0 then '-' else 'p' end when p.motif in (1, 3, 5) then 'p' else 'm' end won, coalesce(m.priority, p.priority) last_ from p full join m on p.pos = m.pos),
  three as (select coalesce(two.pos, d.pos) pos, case when two.pos is null then 'd' when d.pos is null then won when d.priority > last_ then 'd' when d.priority = last_ and won = '-' and d.motif > 0 then 'd' else won end won from two full join d on two.pos = d.pos)
  select 'c' chr, c.s as start, c.s + 50 as "end", (case won when 'p' then 1 when 'm' then 2 when '-' then 0 else case when motif = 0 then 0 when motif in (1, 3, 5) then 1 else 2 end end)::int strand, motif::int motif, shift, priority::int priority
  from three join c on c.pos = three.pos and c.j = 1 and c.strand = case won when 'm' then 2 when 'd' then 0 else 1 end""")
def junction_strands(spark, sf_dir):
    key, size = F.col("p_partkey"), F.col("p_size")
    rows = _t(spark, sf_dir, "part").select(F.lit("c").alias("chr"), F.expr("p_partkey div 5").alias("start"), F.expr("p_partkey div 5 + 50").alias("end"), (F.expr("p_size div 9") % 3).alias("shift"), (key % 3).alias("strand"), F.greatest(size % 9 - 2, F.lit(0)).alias("motif"), F.when(F.expr("p_partkey div 3") % 3 == 0, 20).otherwise(10).alias("priority"))
    return sj.prepared(rows)


@query("""with a as (select l_suppkey % 10 t, l_partkey % 40 a, l_quantity::int n, l_linenumber % 3 clip, 1 + l_orderkey % 2 strand, l_orderkey id from lineitem),
  l as (select *, [greatest(0, least(a + n, k + 30) - greatest(a, k))::int for k in [0, 30, 60]] ls, a // 30 f, (a + n - 1) // 30 e from a),
  h as (select *, f < e and ls[f + 1] < 3 cut1 from l), g as (select *, (f + cut1::int) f2 from h), j as (select *, f2 < e and ls[e + 1] < 3 cut2 from g), k as (select *, e - cut2::int e2 from j),
  m as (select *, clip + case when cut1 then ls[f + 1] else 0 end s1, case when cut2 then ls[e + 1] else 0 end s2, [ls[x + 1] || 'M' for x in range(f2, e2 + 1)] ms, case when f2 = f then a - 30 * f else 0 end o1, case when e2 = e then a + n - 30 * e else 30 end o2 from k),
  c as (select *, case when s1 > 0 then s1 || 'S' else '' end x1, case when s2 > 0 then s2 || 'S' else '' end x2 from m)
  select id, 'g' || t % 3 chr, 1000 * t + case when t % 2 = 0 then 100 * f2 + o1 else 100 * (2 - e2) + 30 - o2 end pos, (case when t % 2 = 0 then strand else 3 - strand end)::int strand,
    case when t % 2 = 0 then x1 || array_to_string(ms, '70N') || x2 else x2 || array_to_string(list_reverse(ms), '70N') || x1 end cigar from c""")
def transcript_cigars(spark, sf_dir):
    clip_ = F.col("l_linenumber") % 3
    whole = F.concat(F.when(clip_ > 0, F.concat(clip_.cast("string"), F.lit("S"))).otherwise(""), F.col("l_quantity").cast("int").cast("string"), F.lit("M"))
    rows = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), (F.col("l_suppkey") % 10).alias("transcript"), (F.col("l_partkey") % 40).alias("pos"), (1 + F.col("l_orderkey") % 2).cast("int").alias("strand"), whole.alias("cigar"))
    t, k, odd = F.expr("id div 3"), F.col("id") % 3, F.expr("id div 3") % 2 == 1
    pieces = spark.range(30).select(t.alias("transcript"), (k * 30).alias("start"), F.lit(30).alias("len"), F.concat(F.lit("g"), (t % 3).cast("string")).alias("chr"), (t * 1000 + F.when(odd, 2 - k).otherwise(k) * 100).alias("g_start"), F.when(odd, 2).otherwise(1).alias("t_strand"))
    return transcripts.to_genome(rows, pieces).select("id", "chr", "pos", "strand", "cigar")


_BASES = "translate({}, '0123456789abcdef', 'ACGTACGTACGTACGT')"
_CHIMERA = {"donor": _BASES.format("md5('d' || p_partkey) || md5('e' || p_partkey)"), "acceptor": _BASES.format("md5('a' || p_partkey) || md5('b' || p_partkey)")}


@query(f"""with s as (select p_partkey id, {_CHIMERA["donor"]} d, {_CHIMERA["acceptor"]} a, (20 + p_size % 9)::int cut, (p_partkey % 3)::int strand, 1 + p_size % 2 s1, 1 + p_partkey % 2 s2 from part),
  w as (select *, substr(d, 5, cut) || substr(a, 5 + cut, 50 - cut) r from s), e as (select *, unnest(range(0, 49)) j from w),
  f as (select id, j, strand, substr(r, j + 1, 1) b, substr(d, j + 5, 1) x, substr(a, j + 5, 1) y, substr(d, j + 6, 2) || substr(a, j + 4, 2) gap from e),
  g as (select *, case when gap = 'GTAG' and strand <> 2 then 1 when gap = 'CTAC' and strand <> 1 then 2 else 0 end motif, sum((b = x)::int - (b = y)::int) over (partition by id order by j) score from f),
  h as (select *, score - (motif = 0)::int total, max(score - (motif = 0)::int) over (partition by id) best from g),
  k as (select id, coalesce(max(case when motif > 0 then j end), min(j)) j from h where total = best group by id),
  z as (select k.id, k.j, w.*, h.motif from k join w on k.id = w.id join h on h.id = k.id and h.j = k.j),
  o as (select id, sum((substr(r, i + 1, 1) = case when i <= j then substr(d, i + 5, 1) else substr(a, i + 5, 1) end)::int * 2 - 1) m from (select *, unnest(range(0, 50)) i from z) group by id),
  p as (select id, max(case when i <= j + 4 and substr(d, i + 1, 1) <> substr(a, i + 1, 1) then i end) lo, min(case when i > j + 4 and substr(d, i + 1, 1) <> substr(a, i + 1, 1) then i end) hi from (select *, unnest(range(0, 64)) i from z) group by id)
  select z.id, (j + 1)::int as "offset", motif::int motif, (j + 4 - coalesce(lo, -1))::int repeat_left, (coalesce(hi, 64) - j - 5)::int repeat_right, case when s1 = 1 then 1000 + j + 1 else 1000 - j - 1 end first_donor, case when s2 = 1 then 9000 + j else 9000 - j end first_acceptor, (m - (motif = 0)::int)::int chim_score
  from z join o on z.id = o.id join p on p.id = z.id where j + 1 >= 20 and 50 - j - 1 >= 20""")
def chimeric_breakpoints(spark, sf_dir):
    part = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), *(F.expr(v).alias(c) for c, v in _CHIMERA.items()), (20 + F.col("p_size") % 9).cast("int").alias("cut"), (F.col("p_partkey") % 3).cast("int").alias("strand"), (1 + F.col("p_size") % 2).alias("strand_1"), (1 + F.col("p_partkey") % 2).alias("strand_2"))
    read = F.concat(F.substring("donor", F.lit(5), F.col("cut")), F.substring("acceptor", F.col("cut") + 5, 50 - F.col("cut")))
    # windows of 4 bases before the read and 10 behind it
    rows = part.select("id", "donor", "acceptor", "strand", "strand_1", "strand_2", read.alias("read"), F.lit(1000).alias("g_1"), F.lit(9000).alias("g_2"))
    return chimeras.breakpoints(rows, 4).drop("donor", "acceptor", "strand", "strand_1", "strand_2", "read", "g_1", "g_2")


@query("select o_orderkey id, case when len(o_clerk_) >= 8 then substr(o_clerk_, 1, 3) || '_' || substr(o_clerk_, 6, 3) end cb, case when len(o_clerk_) >= 5 then substr(o_clerk_, 4, 2) end umi from (select o_orderkey, substr(o_orderpriority, 1, 3 + (o_orderkey % 10)::int) o_clerk_ from orders)")
def barcode_parts(spark, sf_dir):
    seq = F.substring("o_orderpriority", F.lit(1), (3 + F.col("o_orderkey") % 10).cast("int"))
    rows = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), seq.alias("seq"), seq.alias("qual"))
    return bc.cell_and_umi(rows, "CB_UMI_Complex", ((0, 3), (5, 3)), (3, 2)).select("id", "cb", "umi")


@query("select p_partkey id, (case when p_size % 5 = 4 then 0 else 30 - 3 * (p_size % 5) end)::int clip from part")
def oligo_clips(spark, sf_dir):
    oligo = "AAGCAGTGGTATCAACGCAGAGTACATGGG"
    lost = F.when(F.col("p_size") % 5 == 4, 30).otherwise(3 * (F.col("p_size") % 5))
    read = F.concat(F.substring(F.lit(oligo), (lost + 1).cast("int"), F.lit(30)), F.repeat(F.lit("CCTT"), 12))
    return _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), clip.oligo_length(read, oligo).alias("clip"))


@query("""with p as (select l_suppkey % 5 chr, l_partkey % 50 x, max(l_quantity)::int score, l_orderkey * 10000000000 + l_partkey * 100000 + l_suppkey * 10 + l_linenumber as name, 1 + l_orderkey % 5 % 2 nh from lineitem group by l_orderkey, l_partkey, l_suppkey, l_linenumber)
  select name, nh = 1 and row_number() over (partition by chr, x, nh = 1 order by score desc, name) > 1 duplicate from p""")
def duplicate_marks_unique(spark, sf_dir):
    return al.mark_duplicates(_pairs(spark, sf_dir), multi=False).select("name", "duplicate")
