"""The queries of this subpackage, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ann import nearest
from .bpe import bpe_digests, bpe_encode
from .chat_format import END, START, chat_digests, format_chats
from .html_extract import extract_articles
from .imatch import edited_likeness
from .jaccard import jaccard_components
from .lm_score import cross_entropy_difference
from .mixing import mix_sources
from .quality import quality_scores
from .runs import periodic_runs, repeated_tails
from .simhash import simhash_components
from .warc import derivatives, page_responses
from .whiten import grid, whiten


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = END + START + "assistant ok"
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat_digests(format_chats(chats.unionByName(more)))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = table(spark, sf_dir, "labels").where("quality = 1 and toxic = 0").select("doc_id")
    losses = cross_entropy_difference(table(spark, sf_dir, "documents"), good)
    # sums of logarithms are the same on any engine to so many places
    return losses.select("doc_id", "n_tokens", *(F.round(c, 6).alias(c) for c in ("target_loss", "background_loss", "score")))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents").select("doc_id", "source"))


def op5_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = derivatives(page_responses(table(spark, sf_dir, "pages")), keep=("page_id",))
    return made.withColumn("record_sha256", F.sha2("record", 256)).withColumn("record_bytes", F.octet_length("record").cast("long")).drop("record")


def op6_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe_digests(bpe_encode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN), path)


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), k=20, every=20)


def op8_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_likeness(table(spark, sf_dir, "documents"))


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), k=3, percent=90)


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_articles(table(spark, sf_dir, "pages"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(grid(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), scale=64, shift=1_000_000), components=32)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(repeated_tails(table(spark, sf_dir, "documents")), min_length=6, min_exponent=4)
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p"))))
    lines = F.array_join(F.transform("runs", lambda r: F.format_string("%d,%d,%d\n", r["start"], r["length"], r["period"])), "")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.s").alias("start"), (-F.col("best.l")).alias("length"), F.col("best.p").alias("period"),
        F.expr("-1000 * best.l div best.p").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"), k=4, radius=4)


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op")}


#: Texts and roles hold no control string but in conversation -1, where each escaped "<|" is a character longer.
OP1_SQL = """
with t as (
  select conv_id, turn, role, text from conversations
  union all select -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  union all select -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), u as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from t)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
  cast(sum(length(role) + 24 + length(regexp_replace(text, '<(\\\\*)\\|', '<\\\\\\1|', 'g'))) as bigint) as formatted_chars
from u group by conv_id
"""


#: Whole parts near to the square roots of the sources' rows, one period of earliest deadline first as a recursion over the blocks'
#: windows in exact integers, then arithmetic on numbered rows.
OP4_SQL = """
with recursive d as (
  select doc_id, source, coalesce(source, '') as s from documents
), sizes as (select s, count(*) as n from d group by s),
tot as (select sum(sqrt(n)) as t, sum(n) as rows from sizes),
raw as (select s, greatest(1, cast(floor(sqrt(n) / t * 512 + 0.5) as bigint)) as part from sizes, tot),
common as (select list_reduce(list(part), lambda x, y: gcd(x, y)) as c from raw),
shares as (select s, part // c as share from raw, common),
arr as (select list(cast(share as bigint) order by s) as sh, list(s order by s) as ss, cast(sum(share) as bigint) as p from shares),
frame(t, ran, pick) as (
  select cast(-1 as bigint), [cast(0 as bigint) for x in sh], cast(0 as bigint) from arr
  union all
  select t + 1, [case when i = best then r + 1 else r end for r, i in ran], best
  from (
    select t, ran, cast(list_min([{'d': ((ran[i] + 1) * p + x - 1) // x, 'i': i} for x, i in sh if ran[i] * p // x <= t + 1]).i as bigint) as best
    from frame, arr where t < p - 1
  )
), slots as (
  select ss[pick] as s, t as slot, row_number() over (partition by pick order by t) - 1 as nth from frame, arr where pick > 0
), numbered as (
  select doc_id, source, s, row_number() over (partition by s order by
    cast('0x' || substr(md5(cast(doc_id as varchar)), 1, 8) as bigint) % greatest(1, (rows + 1999) // 2000), doc_id) - 1 as i
  from d, tot
)
select doc_id, source, i // 16 as mix_block, cast(i % 16 as int) as mix_pos, (i // 16) // share * p + slot as mix_slot
from numbered join shares using (s) join slots on slots.s = numbered.s and nth = (i // 16) % share, arr
"""


OP7_SQL = """
with e as (
  select vec_id, cast(embedding as double[]) as v from embeddings
  where embedding is not null and vec_id is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0
), s as (
  select q.vec_id as query_id, c.vec_id, list_inner_product(q.v, c.v) as score
  from e q join e c on q.vec_id % 20 = 0 and q.vec_id <> c.vec_id
), r as (select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank, vec_id, score from s)
select query_id, rank, vec_id, score from r where rank <= 20
"""


#: The pages' articles are closed and hold only h1, p, b and br; no page lacks one.
OP10_SQL = """
with a as (
  select page_id, url, list_filter(list_transform(
    regexp_split_to_array(regexp_extract(coalesce(html, ''), '<article[^>]*>(.*)</article>', 1, 's'), '</?(p|h1)(\\s[^>]*)?>'),
    lambda x: trim(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(replace(
      regexp_replace(regexp_replace(x, '<br\\s*/?>', ' ', 'g'), '</?b>', '', 'g'),
      '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', chr(39)), '&#39;', chr(39)), '&copy;', '©'), '&middot;', '·'), '&amp;?', '&', 'g'),
      '[\\s\\x{00A0}\\x{0085}\\x{2028}\\x{2029}]+', ' ', 'g'))
  ), lambda x: x <> '') as b
  from pages
)
select page_id, url, array_to_string(b, chr(10)) as text, length(array_to_string(b, chr(10))) as n_chars from a
"""


#: Words and blanks as the contracts have them: A-Z lowered, split at white space of ASCII.
WORDS_SQL = """
with w as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w
  from documents
)
"""

#: Both models over all texts, each text's own counts taken out of its side.
OP2_SQL = WORDS_SQL.rstrip() + """, good as (select distinct doc_id from labels where quality = 1 and toxic = 0 and doc_id is not null),
d as (select doc_id, w, doc_id in (select doc_id from good) as side from w),
t as (select doc_id, side, unnest(w) as x, unnest(range(len(w))) as i, unnest(list_concat([null], w)[1:len(w)]) as before from d),
n as (select count(distinct x) as v, count(*) filter (where side) as nt, count(*) filter (where not side) as nb from t),
uni as (select x, count(*) filter (where side) as ut, count(*) filter (where not side) as ub from t group by 1),
bi as (select before, x, count(*) filter (where side) as bt, count(*) filter (where not side) as bb from t where i > 0 group by 1, 2),
own as (select doc_id, x, count(*) as o from t group by 1, 2),
own2 as (select doc_id, before, x, count(*) as o from t where i > 0 group by 1, 2, 3),
size as (select doc_id, count(*) as k from t group by 1),
c as (
  select t.doc_id, t.i, k, v, case when side then o1.o else 0 end as ot, case when side then 0 else o1.o end as ob, case when side then o2.o else 0 end as pt, case when side then 0 else o2.o end as pb,
    case when side then o3.o else 0 end as ct, case when side then 0 else o3.o end as cb, nt - case when side then k else 0 end as nt, nb - case when side then 0 else k end as nb,
    a.ut, a.ub, bi.bt, bi.bb, z.ut as zt, z.ub as zb
  from t cross join n join size on size.doc_id = t.doc_id join uni a on a.x = t.x join own o1 on o1.doc_id = t.doc_id and o1.x = t.x
    left join bi on bi.before = t.before and bi.x = t.x left join own2 o2 on o2.doc_id = t.doc_id and o2.before = t.before and o2.x = t.x
    left join uni z on z.x = t.before left join own o3 on o3.doc_id = t.doc_id and o3.x = t.before
), u as (select *, (ut - ot + 0.5) / (nt + 0.5 * (v + 1)) as qt, (ub - ob + 0.5) / (nb + 0.5 * (v + 1)) as qb from c),
p as (select doc_id, -ln(case when i = 0 then qt else (bt - pt + 5.0 * qt) / (zt - ct + 5.0) end) as lt, -ln(case when i = 0 then qb else (bb - pb + 5.0 * qb) / (zb - cb + 5.0) end) as lb from u),
l as (select doc_id, avg(lt) as lt, avg(lb) as lb from p group by 1)
select d.doc_id, cast(len(w) as bigint) as n_tokens, round(lt, 6) as target_loss, round(lb, 6) as background_loss, round(lt - lb, 6) as score from d left join l using (doc_id)
"""

#: All pairs with a common shingle, then everything that links reach.
OP9_SQL = WORDS_SQL.replace("with w as", "with recursive w as", 1).rstrip() + """, s as (
  select doc_id, case when len(w) >= 3 then list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) when len(w) > 0 then [array_to_string(w, ' ')] else [] end as s from w
), x as (select doc_id, len(s) as n, unnest(s) as t from s),
links as (
  select a.doc_id as a, b.doc_id as b from x a join x b on a.t = b.t and a.doc_id <> b.doc_id and 10 * a.n >= 9 * b.n and 10 * b.n >= 9 * a.n
  group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 90 * (a.n + b.n - count(*))
), reach(a, b) as (select doc_id, doc_id from s union select reach.a, links.b from reach join links on reach.b = links.a),
top as (select a, min(b) as c from reach group by a)
select doc_id, cast(len(s) as bigint) as n_shingles, c as component_id from s join top on a = doc_id
"""


#: All pairs of equal words of a text up to a quarter of its length apart, their stretches, the smallest period of each.
OP12_SQL = """
with crc as (
  select doc_id, coalesce(text, '') as t, list_reduce(
    list_concat([cast(4294967295 as bigint)], list_transform(string_split(cast(doc_id as varchar), ''), lambda x: cast(ascii(x) as bigint))),
    lambda c, x: list_reduce(list_concat([xor(c, x)], list_transform(range(8), lambda z: cast(0 as bigint))),
      lambda a, z: case when a % 2 = 1 then xor(a // 2, cast(3988292384 as bigint)) else a // 2 end)) as c
  from documents
), hashed as (select doc_id, t, xor(c, cast(4294967295 as bigint)) as h from crc),
split as (select doc_id, h, h // 10 as g, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from hashed),
cut as (select *, case when len(w) > 0 then g % len(w) end as a from split),
tail as (select *, 1 + (len(w) - a) // (3 + g % 8) as p from cut),
made as (
  select doc_id, case when h % 10 = 0 and len(w) > 0 then list_transform(range(len(w)), lambda i: w[1 + case when i < a then i else a + (i - a) % p end]) else w end as w from tail
), t as (select doc_id, len(w) as n, unnest(w) as x, unnest(range(len(w))) as i from made),
equal as (select s.doc_id, s.i, o.i - s.i as q from t s join t o on s.doc_id = o.doc_id and s.x = o.x and o.i > s.i and 4 * (o.i - s.i) <= s.n),
stretch as (select *, i - row_number() over (partition by doc_id, q order by i) as g from equal),
found as (select doc_id, q, min(i) as s, count(*) + q as l from stretch group by doc_id, q, g having count(*) + q >= greatest(6, 4 * q)),
runs as (select doc_id, s, l, min(q) as q from found group by doc_id, s, l),
gone as (select distinct doc_id, unnest(range(s + q, s + l)) as i from runs),
kept as (select t.doc_id, string_agg(x, ' ' order by t.i) as c from t left join gone on gone.doc_id = t.doc_id and gone.i = t.i where gone.i is null group by t.doc_id),
sums as (
  select doc_id, count(*) as n, string_agg(s || ',' || l || ',' || q || chr(10), '' order by s, q) as r, min(struct_pack(l := -l, s := s, q := q)) as b from runs group by doc_id
)
select doc_id, coalesce(n, 0) as n_runs, b.s as "start", -b.l as "length", b.q as period, -1000 * b.l // b.q as exponent_milli,
  sha256(coalesce(r, '')) as runs_sha256, sha256(coalesce(c, '')) as collapsed_sha256
from made left join sums using (doc_id) left join kept using (doc_id)
"""


def _xxh64(source: str) -> str:
    """Steps of a WITH clause that end in hashed (s, h ubigint): the XXH64, seed 42, of the texts s of a table. Products are taken in 128 bits."""
    m, seed = "18446744073709551616::uhugeint", "42::uhugeint"
    # fixed values of the hash
    p1, p2, p3, p4, p5 = (f"{p}::uhugeint" for p in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))
    mul, add = lambda a, b: f"(({a}) * ({b}) % {m})", lambda a, b: f"((({a}) + ({b})) % {m})"
    turned = lambda x, r: f"((({x}) * {1 << r}::uhugeint) % {m} + ({x}) // {1 << (64 - r)}::uhugeint)"
    step = lambda v, k: mul(turned(add(v, mul(k, p2)), 31), p1)
    read = lambda at, size: "('0x' || " + " || ".join(f"substr(x, {at} + {2 * (size - 1 - i)}, 2)" for i in range(size)) + ")::ubigint::uhugeint"
    down = lambda x, r: f"xor({x}, {x} // {1 << r}::uhugeint)"
    starts = (add(add(seed, p1), p2), add(seed, p2), seed, add(seed, f"{m} - {p1}"))
    lanes = ", ".join(f"list_reduce(list_concat([{v}], list_transform(range(n // 32), lambda i: l[4 * i + {j + 1}])), lambda v, k: {step('v', 'k')}) as v{j}" for j, v in enumerate(starts))
    whole = add(add(add(turned("v0", 1), turned("v1", 7)), turned("v2", 12)), turned("v3", 18))
    joined = "".join(f", x{j} as (select *, {add(mul(f'xor(h{j}, {step("0::uhugeint", f"v{j}")})', p1), p4)} as h{j + 1} from {f'x{j - 1}' if j else 'xs'})" for j in range(4))
    return f"""xb as (select s, hex(encode(s)) as x, strlen(s) as n from {source}),
xl as (select *, list_transform(range(n // 8), lambda i: {read('1 + 16 * i', 8)}) as l from xb),
xa as (select *, {lanes} from xl), xs as (select *, case when n >= 32 then {whole} end as h0 from xa){joined},
xn as (select s, x, n, l, {add(f'coalesce(h4, {add(seed, p5)})', 'n::uhugeint')} as h from x3),
xe as (select s, x, n, list_reduce(list_concat([h], l[n // 32 * 4 + 1:n // 8]), lambda h, k: {add(mul(turned(f'xor(h, {step("0::uhugeint", "k")})', 27), p1), p4)}) as h from xn),
xf as (select s, x, n, case when n % 8 >= 4 then {add(mul(turned(f'xor(h, {mul(read("1 + n // 8 * 16", 4), p1)})', 23), p2), p3)} else h end as h from xe),
xg as (select s, list_reduce(list_concat([h], list_transform(range(n // 4 * 4, n), lambda i: {read('1 + 2 * i', 1)})), lambda h, k: {mul(turned(f'xor(h, {mul("k", p5)})', 11), p1)}) as h from xf),
xh as (select s, {mul(down('h', 33), p2)} as h from xg), xi as (select s, {mul(down('h', 29), p3)} as h from xh),
hashed as (select s, {down('h', 32)}::ubigint as h from xi)"""


#: All pairs of fingerprints, then everything that links reach.
OP13_SQL = WORDS_SQL.replace("with w as", "with recursive w as", 1).rstrip() + f""", sh as (
  select doc_id, unnest(case when len(w) >= 4 then list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s from w
), given as (select distinct s from sh), {_xxh64("given")},
bits as (select doc_id, ({" + ".join(f"case when 2 * sum((h >> {b}) & 1) > count(*) then {1 << b}::uhugeint else 0::uhugeint end" for b in range(64))})::ubigint as f from sh join hashed using (s) group by doc_id),
fp as (select w.doc_id, coalesce(f, 0::ubigint) as f from w left join bits using (doc_id)),
node as (select f, min(doc_id) as low from fp group by f),
link as (select a.f as a, b.f as b from node a join node b on bit_count(xor(a.f, b.f)::bit) <= 4),
reach(a, b) as (select f, f from node union select reach.a, link.b from reach join link on reach.b = link.a),
top as (select a, min(low) as c from reach join node on node.f = reach.b group by a)
select doc_id, lower(lpad(to_hex(f), 16, '0')) as fingerprint, c as component_id from fp join top on a = f
"""


def oracle_sql() -> dict[str, str]:
    return {"op13_simhash_near_dedup": OP13_SQL, "op12_periodic_runs": OP12_SQL, "op2_lm_scoring": OP2_SQL, "op9_ngram_jaccard_join": OP9_SQL, "op10_html_extraction": OP10_SQL, "op7_nearest_neighbours": OP7_SQL, "op4_mixing_sources": OP4_SQL, "op1_chat_formatting": OP1_SQL}
