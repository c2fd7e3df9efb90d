"""The registered queries of this subpackage and their SQL counterparts."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from twinsift.llm.conversation_repair import damage, repair
from twinsift.llm.decontaminate import contaminated
from twinsift.llm.embedding_join import near_duplicates
from twinsift.llm.mixing import mix
from twinsift.llm.ngram_join import similar_documents
from twinsift.llm.packing import pack, pieces
from twinsift.llm.quality_crf import score_quality
from twinsift.llm.substring import remove_repeats
from twinsift.llm.template_tree import drop_recurring_lines
from twinsift.llm.toxicity import score_toxicity
from twinsift.llm.url_filter import judge_urls
from twinsift.llm.warc import read_archive, write_archive
from twinsift.llm.whitening import whiten
from twinsift.session import shared_dir

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame under its own name."""

    def register(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return register


def table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_WORDS = r"list_filter(string_split_regex({text}, '[\x20\x09-\x0D]+'), lambda w: w <> '')"


@query(
    r"""
    with docs as (
        select doc_id, source,
            coalesce(len(list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda w: w <> '')), 0)::bigint as size,
            ('0x' || substr(md5(coalesce(doc_id::varchar, '-') || ':' || coalesce(text, '')), 1, 15))::bigint as hash
        from documents
    ),
    sources as (
        select source, sum(size)::bigint as source_size,
            ((row_number() over (order by source is null, source)) - 1) % 3 + 1 as weight
        from docs group by source
    ),
    filled as (
        select *, row_number() over (order by 3.0 * source_size / weight, source) as k from sources
    ),
    levels as (
        select k, (select sum(source_size) from sources) - coalesce(sum(3 * source_size) over w, 0) as words,
            (select sum(weight) from sources) - coalesce(sum(weight) over w, 0) as parts
        from filled window w as (order by k rows between unbounded preceding and 1 preceding)
    ),
    level as (
        select words, parts from filled join levels using (k)
        where filled.weight * words <= 3 * source_size::hugeint * parts order by k limit 1
    ),
    targets as (
        select source, source_size,
            case when weight * words > 3 * source_size::hugeint * parts then (3 * source_size)::double
                else weight * words::double / parts::double end as target
        from sources, level
    ),
    budgets as (
        select *, case when source_size = 0 then 0 else floor(target / source_size)::bigint end as whole from targets
    ),
    ordered as (
        select docs.*, b.source_size, b.target, b.whole, b.target - b.whole * b.source_size as budget,
            sum(size) over (partition by docs.source order by hash rows between unbounded preceding and current row) as upto,
            size as here
        from docs join budgets b on docs.source is not distinct from b.source
    )
    select doc_id, source, size, source_size, target,
        least(3, whole + case when budget > 0 and (upto <= budget
            or (upto - here <= budget and upto - budget <= budget - (upto - here))) then 1 else 0 end)::bigint as repeats,
        size * repeats as taken
    from ordered
    """
)
def op1_mix_sources(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents"))


@query(
    f"""
    with recursive docs as (
        select doc_id, {_WORDS.format(text="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} as w
        from documents
    ),
    grams as (
        select distinct doc_id, array_to_string(list_slice(w, i, i + 4), ' ') as gram
        from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i from docs where len(w) > 0)
    ),
    sizes as (select doc_id, count(*) as n from grams group by doc_id),
    common as (
        select x.doc_id as a, y.doc_id as b, count(*) as c
        from grams x join grams y on x.gram = y.gram and x.doc_id <> y.doc_id group by all
    ),
    links as (
        select a, b from common join sizes s on s.doc_id = a join sizes t on t.doc_id = b
        where 100 * c >= 75 * (s.n + t.n - c)
    ),
    reach as (
        select doc_id as a, doc_id as b from documents
        union
        select reach.a, links.b from reach join links on reach.b = links.a
    )
    select d.doc_id, coalesce(s.n, 0)::bigint as n_shingles, m.component_id
    from documents d left join sizes s using (doc_id)
    join (select a as doc_id, min(b) as component_id from reach group by a) m using (doc_id)
    """
)
def op2_ngram_jaccard_join(spark, sf_dir):
    return similar_documents(table(spark, sf_dir, "documents"))


@query(
    f"""
    with docs as (select doc_id, {_WORDS.format(text="coalesce(text, '')")} as w from documents),
    windows as (
        select doc_id, i, array_to_string(list_slice(w, i, i + 12), ' ') as gram
        from (select doc_id, w, unnest(range(1, len(w) - 11)) as i from docs where len(w) >= 13)
    ),
    owners as (select gram, min(doc_id) as owner from windows group by gram),
    gone as (
        select distinct doc_id, i + o as i
        from windows join owners using (gram), unnest(range(0, 13)) as t(o) where owner < doc_id
    ),
    words as (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as i from docs),
    kept as (
        select words.doc_id, string_agg(word, ' ' order by words.i) filter (gone.i is null) as text,
            count(*) as n_words, count(gone.i) as n_removed
        from words left join gone on gone.doc_id = words.doc_id and gone.i = words.i group by words.doc_id
    )
    select docs.doc_id, coalesce(n_words, 0)::bigint as n_words, coalesce(n_removed, 0)::bigint as n_removed,
        sha256(coalesce(text, '')) as kept_sha256
    from docs left join kept on kept.doc_id = docs.doc_id
    """
)
def op6_substring_dedup(spark, sf_dir):
    return remove_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256")
    )


@query(
    r"""
    with payloads as (
        select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as hex from pages
    ),
    grouped as (select *, max(page_id) over (partition by html) as response from payloads)
    select page_id, strlen(html)::bigint as payload_bytes,
        array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
            ((((instr('0123456789abcdef', substr(hex, (5 * i // 4 + 1)::int, 1)) - 1) * 16
              + (instr('0123456789abcdef', substr(hex, (5 * i // 4 + 2)::int, 1)) - 1))
              // (case 5 * i % 4 when 0 then 8 when 1 then 4 when 2 then 2 else 1 end)) % 32 + 1)::int, 1)), '') as payload_digest,
        case when page_id = response then 'response' else 'revisit' end as record_type,
        case when page_id <> response then response end as refers_to
    from grouped
    """
)
def op4_warc(spark, sf_dir):
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archive(table(spark, sf_dir, "pages"), folder)
    return read_archive(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


@query(
    r"""
    with parts as (
        select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages
    ),
    split as (
        select page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
            regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) as path
        from parts
    ),
    rules(h, p, action) as (
        values ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
            ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
    ),
    fits as (
        select distinct host, path, h || p as rule, action from split join rules
        on (host = h or ends_with(host, '.' || h)) and starts_with(path, p)
    ),
    best as (select host, path, arg_max(rule, length(rule)) as rule, arg_max(action, length(rule)) as action from fits group by all)
    select page_id, host, path, rule, coalesce(action, 'allow') as verdict from split left join best using (host, path)
    """
)
def op7_url_filters(spark, sf_dir):
    rules = spark.createDataFrame(_URL_RULES, "host string, path string, action string")
    return judge_urls(table(spark, sf_dir, "pages"), rules)


@query(
    """
    with recursive vectors as (
        select vec_id, label, embedding::double[] as v from embeddings
        where label is not null and embedding is not null
            and len(list_filter(embedding::double[], lambda x: x is null or not isfinite(x))) = 0
            and list_inner_product(embedding::double[], embedding::double[]) > 0
    ),
    links as (
        select x.vec_id as a, y.vec_id as b from vectors x join vectors y
        on x.label = y.label and x.vec_id <> y.vec_id
        where list_inner_product(x.v, y.v) / (sqrt(list_inner_product(x.v, x.v)) * sqrt(list_inner_product(y.v, y.v))) >= 0.98
    ),
    reach as (
        select vec_id as a, vec_id as b from embeddings
        union
        select reach.a, links.b from reach join links on reach.b = links.a
    ),
    component as (select a as vec_id, min(b) as component_id from reach group by a)
    select e.vec_id, (select count(*) from links where a = e.vec_id)::bigint as n_links, component_id,
        e.vec_id = component_id as kept
    from embeddings e join component c on c.vec_id = e.vec_id
    """
)
def op8_embedding_near_dedup(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "embeddings"))


@query()
def op9_line_dedup(spark, sf_dir):
    return drop_recurring_lines(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256")
    )


@query()
def op10_benchmark_decontamination(spark, sf_dir):
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query()
def op3_quality_classifier(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_quality(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


@query()
def op5_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_toxicity(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


@query()
def op11_best_fit_packing(spark, sf_dir):
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    return pack(pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN))


# The drawn damage, faults, costs and audits as SQL. A conversation is worked off from its end; v0 to v3
# are the cost-to-go and best audit of the four grammar states.
_CRC32 = """
    xor(list_reduce(
        [4294967295::bigint] || list_transform(string_split({text}, ''), lambda c: ascii(c)::bigint),
        lambda x, b: list_reduce([xor(x, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda y, z: xor(y >> 1, 3988292384 * (y & 1)))
    ), 4294967295)
"""


def _least_of(*options: str) -> str:
    return f"list_min([{', '.join(options)}])"


def _step(cost: str, letter: str, state: int) -> str:
    return f"{{'c': v{state}.c + {cost}, 'a': '{letter}' || v{state}.a}}"


def _without_insert(state: int) -> str:
    """Cost and audit of a state before a row, if nothing is inserted first."""
    keep = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}[state]
    given = {0: 2, 1: 2, 2: 3, 3: 2}[state]
    delete = _step("3", "D", state)
    rerole = _step("2 + extra", "R", given)
    cases = " ".join(
        f"when initial = '{i}' then {_least_of(delete, rerole, _step('extra', 'K', then))}" for i, then in keep.items()
    )
    return f"case when gone then {delete} {cases} else {_least_of(delete, rerole)} end"


@query(
    rf"""
    with recursive drawn as (
        select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
            {_CRC32.format(text="coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ')")} % 20 as d
        from conversations
    ),
    damaged as (
        select conv_id, turn, case when d = 4 then 'user' else role end as role,
            case when d = 1 then '' when d = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text
        from drawn, unnest(range(0, case when d = 3 then 2 else 1 end)) as t(i) where d <> 0
    ),
    placed as (
        select *, row_number() over (partition by conv_id order by turn nulls first, role, sha256(text)) as k,
            count(*) over (partition by conv_id) as n,
            regexp_extract(text, '([^ 	-
])[ 	-
]*$', 1) as final
        from damaged
    ),
    faults as (
        select *, final = '' as blank, final <> '' and nth > 1 as duplicate,
            final not in ('', '.', '!', '?') and nth = 1 as truncated, substr(role, 1, 1) as initial
        from (select *, row_number() over (partition by conv_id, role, text order by k) as nth from placed)
    ),
    judged as (
        select *, blank or duplicate as gone, truncated::int as extra,
            coalesce(lag(initial) over (partition by conv_id order by k) || initial not in ('su', 'ua', 'au'), false) as illegal
        from faults
    ),
    solved as (
        select conv_id, n + 1 as k, {{'c': 0, 'a': ''}} as v0, {{'c': 4, 'a': 'II'}} as v1,
            {{'c': 2, 'a': 'I'}} as v2, {{'c': 0, 'a': ''}} as v3
        from (select distinct conv_id, n from judged)
        union all
        select conv_id, k, {_least_of("n0", "{'c': i2.c + 2, 'a': 'I' || i2.a}")}, {_least_of("n1", "{'c': i2.c + 2, 'a': 'I' || i2.a}")},
            i2, {_least_of("n3", "{'c': n2.c + 2, 'a': 'I' || n2.a}")}
        from (
            select *, {_least_of("n2", "{'c': n3.c + 2, 'a': 'I' || n3.a}")} as i2
            from (
                select j.conv_id, j.k, {", ".join(f"{_without_insert(s)} as n{s}" for s in range(4))}
                from solved s join judged j on j.conv_id is not distinct from s.conv_id and j.k = s.k - 1
            )
        )
    ),
    audits as (select conv_id, v0.c as cost, v0.a as audit from solved where k = 1),
    letters as (
        select conv_id, unnest(string_split(audit, '')) as letter, unnest(range(1, length(audit) + 1)) as pos from audits where audit <> ''
    ),
    numbered as (
        select *, sum((letter <> 'I')::int) over w as k, sum((letter <> 'D')::int) over w as nth_out
        from letters window w as (partition by conv_id order by pos)
    ),
    opened as (
        select x.conv_id, x.pos, x.letter, x.nth_out, j.role, j.text, bool_or(x.nth_out = 1 and x.letter = 'K' and j.initial = 's')
            over (partition by x.conv_id) as with_system
        from numbered x left join judged j on j.conv_id is not distinct from x.conv_id and j.k = x.k and x.letter <> 'I'
        where x.letter <> 'D'
    ),
    written as (
        select conv_id, string_agg(
                case when letter = 'K' then role when (nth_out + with_system::int) % 2 = 1 then 'user' else 'assistant' end
                    || ':' || case when letter = 'I' then '' else text end, chr(10) order by pos) as repaired
        from opened group by conv_id
    ),
    totals as (
        select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, sum(blank::int) as blank,
            sum(duplicate::int) as duplicate, sum(truncated::int) as truncated, sum(illegal::int) as illegal
        from judged group by conv_id
    )
    select c.conv_id, {", ".join(f"coalesce({x}, 0)::bigint as {x}" for x in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost"))},
        coalesce(audit, '') as audit, sha256(coalesce(repaired, '')) as repaired_sha256
    from (select distinct conv_id from conversations) c
    left join totals t on t.conv_id is not distinct from c.conv_id
    left join audits a on a.conv_id is not distinct from c.conv_id
    left join written w on w.conv_id is not distinct from c.conv_id
    """
)
def op12_conversation_structure_repair(spark, sf_dir):
    conversations = table(spark, sf_dir, "conversations")
    return repair(damage(conversations), conversations)


@query()
def op13_embedding_whitening(spark, sf_dir):
    return whiten(table(spark, sf_dir, "embeddings"))
