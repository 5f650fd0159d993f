"""The registered queries of this subpackage, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import table
from .ann_graph import nearest_neighbours
from .chat import format_chats, read_back
from .curriculum import allocate, in_order, with_first_position
from .decontaminate import contaminated
from .jaccard_join import jaccard_classes
from .line_dedup import dedup_lines
from .quality import quality_scores
from .secrets import find_secrets
from .suffix_dedup import drop_repeats
from .suffix_tree_lm import tree_scores


def op1_ann_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 100 == 0)


def op2_quality_discriminant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_suffix_tree_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree_scores(table(spark, sf_dir, "documents"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.sql(f"select -7L conv_id, 0L turn, 'user' role, '{said}' text union all select -7L, 1L, 'assistant', '{said}'")
    back = read_back(format_chats(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines.cast("binary"), 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"), F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    def of(kind):
        return F.filter("findings", lambda x: x["kind"] == kind)

    counts = [F.size(of(kind)).cast("long").alias(f"n_{kind}") for kind in ("assign", "access", "hex")]
    base = joined(F.filter("findings", lambda x: x["kind"] != "entropy"))
    return found.select("doc_id", *counts, F.sha2(base.cast("binary"), 256).alias("base_sha256"), joined("findings").alias("spans"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_item", "n_shared", "containment")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("key.doc_id", "n_lines", "n_removed", "n_runs", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents"), count_links=False).select("doc_id", "n_shingles", "component_id")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("key.doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op10_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = with_first_position(allocate(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), keep_text=False))
    return in_order(mixed, "mix_position", "id").select("key.doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), F.col("mix_taken").alias("taken"), F.col("mix_position").alias("first_position"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ann_graph": op1_ann_graph,
    "op2_quality_discriminant": op2_quality_discriminant,
    "op3_suffix_tree_lm": op3_suffix_tree_lm,
    "op4_chat_format": op4_chat_format,
    "op5_secret_scan": op5_secret_scan,
    "op6_decontaminate": op6_decontaminate,
    "op7_line_dedup": op7_line_dedup,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_curriculum_mix": op10_curriculum_mix,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

ORACLES: dict[str, str] = {}

ORACLES["op4_chat_format"] = r"""
with c as (select conv_id, turn, coalesce(role, '') role, coalesce(text, '') text from conversations
           union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
     e as (select *, len(regexp_replace(role || chr(0), '([<\[])(\\*)(/?s>|/?INST\])', '\1\\\2\3', 'g'))
                   + len(regexp_replace(text || chr(0), '([<\[])(\\*)(/?s>|/?INST\])', '\1\\\2\3', 'g')) - 2 n from c)
select conv_id, count(*) n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) turns_sha256,
       coalesce(sum(len(text)) filter (where role = 'assistant'), 0)::bigint loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) loss_sha256,
       (3 + sum(n + 6 + 7 + 4))::bigint formatted_chars
from e group by conv_id
"""

ORACLES["op6_decontaminate"] = rf"""
with d as (select doc_id, {_WORDS.format(_LOWER)} ws from documents),
     i as (select item_id, {_WORDS.format(_LOWER)} ws from benchmark),
     ds as (select distinct doc_id, array_to_string(ws[k:k+4], ' ') s from (select doc_id, ws, unnest(range(1, len(ws) - 3)) k from d)),
     s as (select distinct item_id, array_to_string(ws[k:k+4], ' ') s from (select item_id, ws, unnest(range(1, len(ws) - 3)) k from i)),
     n as (select item_id, count(*) n_item from s group by 1),
     p as (select doc_id, item_id, count(*) n_shared from ds join s using (s) group by 1, 2)
select doc_id, item_id, n_item, n_shared, n_shared / n_item as containment from p join n using (item_id) where 4 * n_shared >= 3 * n_item
"""

ORACLES["op7_line_dedup"] = """
with d as (select doc_id, string_split(text, chr(10)) ls from documents where text is not null),
     w as (select doc_id, s, ls[s:s+1] v from (select doc_id, ls, unnest(range(1, len(ls))) s from d)),
     l as (select doc_id, s from (select doc_id, s, row_number() over (partition by v order by doc_id, s) r from w) where r > 1),
     g as (select distinct doc_id, s from (select doc_id, s from l union all select doc_id, s + 1 from l)),
     x as (select doc_id, i, ls[i] t, (doc_id, i) in (select (doc_id, s) from g) gone from (select doc_id, ls, unnest(range(1, len(ls) + 1)) i from d)),
     y as (select *, coalesce(lag(gone) over (partition by doc_id order by i), false) was from x)
select doc_id, count(*) n_lines, cast(sum(case when gone then 1 else 0 end) as bigint) n_removed,
       cast(sum(case when gone and not was then 1 else 0 end) as bigint) n_runs,
       sha256(coalesce(string_agg(t, chr(10) order by i) filter (where not gone), '')) kept_sha256
from y group by doc_id
"""

ORACLES["op8_jaccard_join"] = rf"""
with recursive d as (select doc_id, {_WORDS.format(_LOWER)} ws from documents),
     s as (select distinct doc_id, array_to_string(ws[k:k+4], ' ') s from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) k from d where len(ws) > 0)),
     n as (select doc_id, count(*) n from s group by 1),
     p as (select a.doc_id x, b.doc_id y, count(*) k from s a join s b using (s) where a.doc_id <> b.doc_id group by 1, 2),
     e as (select x, y from p join n a on a.doc_id = x join n b on b.doc_id = y where 100 * k >= 75 * (a.n + b.n - k)),
     r(doc_id, c) as (select doc_id, doc_id from d union select e.y, r.c from r join e on e.x = r.doc_id where r.c < e.y)
select d.doc_id, coalesce(n.n, 0) n_shingles, m.c component_id
from d left join n using (doc_id) join (select doc_id, min(c) c from r group by 1) m on m.doc_id = d.doc_id
"""

ORACLES["op9_suffix_dedup"] = """
with d as (select doc_id, hex(encode(coalesce(text, ''))) h from documents),
     w as (select doc_id, p, md5(substr(h, 2 * p + 1, 400)) k from (select doc_id, h, unnest(range(0, len(h) // 2 - 199)) p from d)),
     g as (select doc_id, p from w where k in (select k from w group by k having count(*) > 1)),
     i as (select doc_id, p, sum(case when p - q <= 200 then 0 else 1 end) over (partition by doc_id order by p) n
           from (select doc_id, p, lag(p) over (partition by doc_id order by p) q from g)),
     s as (select doc_id, min(p) a, max(p) + 200 b from i group by doc_id, n),
     c as (select doc_id, a, b, coalesce(lag(b) over (partition by doc_id order by a), 0) e from s),
     t as (select doc_id, sum(b - a)::bigint n_removed, count(*) n_spans, max(b) z from s group by doc_id),
     k as (select c.doc_id, string_agg(substr(h, 2 * e + 1, 2 * (a - e)), '' order by a) h from c join d using (doc_id) group by c.doc_id)
select d.doc_id, (len(d.h) // 2)::bigint n_bytes, coalesce(n_removed, 0) n_removed, coalesce(n_spans, 0) n_spans,
       sha256(unhex(case when k.h is null then d.h else k.h || substr(d.h, 2 * z + 1) end)) kept_sha256
from d left join t using (doc_id) left join k using (doc_id)
"""

_CLASSES = ((0.0, 1.5, 1.0, 0.5),), ((0.0, 1.0, 1.0, 1.0),), ((0.0, 0.25, 0.5, 1.0), (0.5, 1.0, 1.0, 1.75))


def _sql_position() -> str:
    """The time at which the part p of each class's schedule is reached."""
    cases = []
    for k, pieces in enumerate(_CLASSES):
        area = sum((t1 - t0) * (v0 + v1) / 2 for t0, v0, t1, v1 in pieces)
        begin, inner = 0.0, []
        for t0, v0, t1, v1 in pieces:
            end, slope = begin + (t1 - t0) * (v0 + v1) / 2, (v1 - v0) / (t1 - t0)
            rest = f"greatest(p * {area!r}::double - {begin!r}::double, 0.0::double)"
            inner.append((end, f"{t0!r}::double + 2.0::double * {rest} / ({v0!r}::double + sqrt(greatest({v0 * v0!r}::double + {2 * slope!r}::double * {rest}, 0.0::double)))"))
            begin = end
        body = inner[-1][1]
        for end, text in reversed(inner[:-1]):
            body = f"case when p * {area!r}::double < {end!r}::double then {text} else {body} end"
        cases.append(f"when cls = {k} then least({body}, 1.0::double)")
    return f"case {' '.join(cases)} end"


ORACLES["op10_curriculum_mix"] = rf"""
with recursive d as (select doc_id, source, len({_WORDS.format("coalesce(text, '')")})::bigint size from documents),
     s as (select source, sum(size)::bigint source_size, row_number() over (order by source nulls last) - 1 i from d group by source),
     w as (select *, (i % 3)::int cls, [5, 2, 1][(i % 3)::int + 1]::bigint w, 2 * source_size cap from s),
     f(step, i, full_) as (
        select 0, i, false from w
        union all
        select step + 1, i, full_ or w * rest >= cap * open_ * 2 from (
            select f.step, f.i, f.full_, w.w, w.cap,
                   3 * sum(w.source_size) over () - 2 * sum(case when f.full_ then w.cap else 0 end) over () rest,
                   sum(case when f.full_ then 0 else w.w end) over () open_
            from f join w using (i) where f.step < (select count(*) from w))),
     last as (select i, full_ from f where step = (select max(step) from f)),
     t as (select w.*, last.full_, 3 * sum(source_size) over () - 2 * sum(case when full_ then cap else 0 end) over () rest,
                  sum(case when full_ then 0 else w end) over () open_ from w join last using (i)),
     g as (select source, source_size, cls, case when full_ then cap::double else (w * rest)::bigint::double / (open_ * 2)::bigint::double end target from t),
     o as (select d.doc_id, d.size, g.*, coalesce(sum(d.size) over (partition by d.source order by md5(d.doc_id::varchar), d.doc_id, d.size rows between unbounded preceding and 1 preceding), 0)::bigint begin_
           from d join g on d.source is not distinct from g.source),
     x as (select *, (greatest(least(size, floor(target)::bigint - begin_), 0) + greatest(least(size, floor(target)::bigint - begin_ - source_size), 0))::bigint taken from o),
     y as (select *, case when taken > 0 then least(begin_::double / target, 1.0::double) end p from x)
select doc_id, size, source_size, target, taken, case when taken > 0 then {_sql_position()} end first_position from y
"""
