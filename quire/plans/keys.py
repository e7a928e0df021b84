"""Lexicon keys, variants, ranked look-ups and tokens over the originals and the lexicon."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from quire.functions import keys as K
from quire.functions import text as T
from quire.sources.tables import read

EDGE = r"[.,;:·!?()\[\]«»“”\"'’—…]"


def _tokens(s, d, lang: str):
    """Distinct words of the originals of a language, trimmed of edge punctuation."""
    w = read(s, d, "gsents").where(F.col("lang") == lang).select(F.explode(F.split("text", r"\s+")).alias("w"))
    return w.select(F.regexp_replace("w", f"^{EDGE}+|{EDGE}+$", "").alias("w")).where("w <> ''").distinct()


def beta_full(s, d):
    """Words of the Greek originals with their key; words with other characters give none."""
    return _tokens(s, d, "grc").select("w", K.beta_key(F.col("w")).alias("key"))


def key_failures(s, d):
    """Words of Greek originals that have no key, and how many stand in each language's text."""
    w = read(s, d, "gsents").where("lang = 'grc'").select(F.explode(F.split("text", r"\s+")).alias("w")).select(F.regexp_replace("w", f"^{EDGE}+|{EDGE}+$", "").alias("w")).where("w <> ''")
    return w.where(K.beta_key(F.col("w")).isNull()).groupBy("w").agg(F.count(F.lit(1)).alias("n"))


def capital_keys(s, d):
    return _tokens(s, d, "grc").select("w", K.capital_key(K.beta_key(F.col("w"))).alias("key")).where("key is not null")


def greek_variants(s, d):
    """Each word's keys in the order to try; names only for words with a capital."""
    k = K.beta_key(F.col("w"))
    return _tokens(s, d, "grc").where(k.isNotNull()).select("w", F.posexplode(K.greek_variants(k, F.col("w").rlike(r"^\p{Lu}"))).alias("rank", "key")).withColumn("rank", F.col("rank").cast("long"))


def latin_variants(s, d):
    w = F.col("w")
    return _tokens(s, d, "lat").select("w", F.posexplode(K.latin_variants(K.latin_key(w), w.rlike("^[A-Z]"))).alias("rank", "key")).withColumn("rank", F.col("rank").cast("long"))


def variant_lookup(s, d):
    """Words of the Latin originals by the first of their variants that the lexicon has."""
    w = F.col("w")
    tall = _tokens(s, d, "lat").select("w", F.posexplode(K.latin_variants(K.latin_key(w), w.rlike("^[A-Z]"))).alias("rank", "form"))
    hit = tall.join(read(s, d, "analyses").where("lang = 'lat'").select("form", "lemma").distinct(), "form")
    return hit.groupBy("w").agg(F.min(F.struct("rank", "lemma")).alias("b")).select("w", F.col("b.rank").cast("long").alias("rank"), F.col("b.lemma").alias("lemma"))


def fold_dispatch(s, d):
    """The search key of each lexicon form by its language; a language without a rule gives an error."""
    f = F.col("form")
    key = F.when(F.col("lang") == "grc", T.beta(f)).when(F.col("lang").isin("lat", "de", "fr", "en"), T.fold(f)).when(F.col("lang").isNull(), F.lit(None).cast("string")).otherwise(F.raise_error(F.concat(F.lit("no fold for "), F.col("lang"))).cast("string"))
    return read(s, d, "analyses").select("form", "lang", key.alias("key"))


def dict_keys(s, d):
    """Dictionary keys of the lexicon (with homonym numbers), as base and folded keys."""
    k = read(s, d, "analyses").select(F.explode("lsj").alias("entry")).distinct()
    return k.select("entry", K.base_key(F.col("entry")).alias("base"), K.fold_key(F.col("entry")).alias("fold"))


def lemma_cascade(s, d):
    """Lemmata to dictionary entries: by the first index that holds any, all its entries (homonyms) kept."""
    a = read(s, d, "analyses")
    entries = a.select(F.explode("lsj").alias("entry")).distinct()
    index = entries.select("entry", F.explode(F.array(*[F.struct(F.lit(n).alias("index"), k.alias("key")) for n, k in (("exact", F.col("entry")), ("base", K.base_key(F.col("entry"))), ("fold", K.fold_key(F.col("entry"))))])).alias("x")).select("entry", "x.index", "x.key")
    tall = a.select("lemma").distinct().select("lemma", F.posexplode(K.lemma_candidates(F.col("lemma"))).alias("rank", "c")).select("lemma", "rank", "c.index", "c.key")
    hit = tall.join(index, ["index", "key"]).withColumn("first", F.min("rank").over(Window.partitionBy("lemma")))
    return hit.where("rank = first").select("lemma", F.col("rank").cast("long").alias("rank"), "entry").distinct()


def gloss_extend(s, d):
    """Glosses cut short, replaced by a longer one of the same lemma that begins with them at a word's end."""
    g = read(s, d, "analyses").where("gloss is not null").select("lemma", "lang", "gloss").distinct()
    short = g.select("lemma", "lang", T.collapse(F.regexp_extract("gloss", "^([^;]*)", 1)).alias("short")).distinct()
    hit = short.join(g, ["lemma", "lang"]).withColumn("a", K.gloss_norm(F.col("short"))).withColumn("b", K.gloss_norm(F.col("gloss")))
    hit = hit.where("a <> '' and length(b) > length(a) and startswith(b, a) and substring(b, length(a) + 1, 1) not rlike '[a-z0-9_]'")
    return hit.groupBy("lemma", "lang", "short").agg(F.min("gloss").alias("gloss"))


def gloss_norm(s, d):
    return read(s, d, "analyses").where("gloss is not null").select("form", "lang", K.gloss_norm(F.col("gloss")).alias("gloss")).distinct()


def edition_norm(s, d):
    return read(s, d, "chapter_refs").where("ross_text is not null").select("chapter_id", F.md5(K.edition_norm(F.col("ross_text"))).alias("key")).distinct()


def accent_pairs(s, d):
    """Words of the Greek originals that differ by accents alone, by their form without."""
    w = _tokens(s, d, "grc").select(K.accent_key(F.col("w")).alias("w")).distinct()
    return w.groupBy(T.strip_accents(F.col("w")).alias("bare")).agg(F.count(F.lit(1)).alias("n"), F.min("w").alias("first_form"), F.max("w").alias("last_form")).where("n > 1")


def greek_numerals(s, d):
    """Whole tokens of originals and fragments that are Greek numerals."""
    t = read(s, d, "gsents").select("text").unionByName(read(s, d, "fragments").select("text"))
    w = t.select(F.explode(F.split("text", r"[\s—]+")).alias("w"))
    return w.groupBy(K.is_greek_numeral(F.col("w")).alias("numeral")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("w").alias("words"))


def token_walk(s, d):
    """Tokens of each original with their exact offsets: split at white space and dashes, edges trimmed."""
    g = read(s, d, "gsents").where("text is not null and sent_id is not null").select("sent_id", "text").distinct()
    raw = F.regexp_extract_all("text", F.lit(r"[^\s—]+|[\s—]+"), F.lit(0))
    at = F.aggregate("p", F.struct(F.lit(0).alias("o"), F.array().cast("array<struct<o:int,t:string>>").alias("out")), lambda acc, x: F.struct((acc["o"] + F.length(x)).alias("o"), F.when(x.rlike(r"^[^\s—]"), F.array_append(acc["out"], F.struct(acc["o"].alias("o"), x.alias("t")))).otherwise(acc["out"]).alias("out")), lambda acc: acc["out"])
    toks = g.select("sent_id", raw.alias("p")).select("sent_id", F.posexplode(at).alias("pos", "x"))
    lead = F.length(F.regexp_extract("x.t", f"^{EDGE}*", 0))
    out = toks.select("sent_id", F.col("pos").cast("long").alias("pos"), (F.col("x.o") + lead).cast("long").alias("offset"), F.regexp_replace("x.t", f"^{EDGE}+|{EDGE}+$", "").alias("token"))
    return out.where("token <> ''")


def token_offsets_wrong(s, d):
    """The check of the walk: tokens that do not stand at their offset, counted beside all."""
    g = read(s, d, "gsents").where("text is not null and sent_id is not null").select("sent_id", "text").distinct()
    t = token_walk(s, d).join(g, "sent_id")
    wrong = F.substring("text", F.col("offset") + 1, F.length("token")) != F.col("token")
    return t.agg(F.count(F.lit(1)).alias("tokens"), F.sum(wrong.cast("long")).alias("wrong"))


def greek_words_at(s, d):
    """Greek words of fragments with offsets, as a gap's filler is matched against them."""
    f = read(s, d, "fragments").where("text is not null and frag_id is not null").select("frag_id", "text").distinct()
    p = F.regexp_extract_all("text", F.lit(r"[Ͱ-Ͽἀ-῿]+|[^Ͱ-Ͽἀ-῿]+"), F.lit(0))
    w = f.select("frag_id", p.alias("p")).select("frag_id", "p", F.posexplode("p").alias("i", "word"))
    at = F.length(F.array_join(F.slice("p", F.lit(1), F.col("i")), ""))
    return w.where(F.col("word").rlike("^[Ͱ-Ͽἀ-῿]")).select("frag_id", at.cast("long").alias("offset"), "word")


def probe_windows(s, d):
    """Overlapping windows of 24 letters, every 12, and one at the tail, of each fragment's letters."""
    f = read(s, d, "fragments").where("frag_id is not null and text is not null").select("frag_id", T.letters_only(F.col("text")).alias("t")).distinct().where("length(t) >= 24")
    last = F.length("t") - 24
    starts = F.array_distinct(F.concat(F.sequence(F.lit(0), last, F.lit(12)), F.array(last)))
    return f.select("frag_id", "t", F.explode(starts).alias("at")).select("frag_id", F.col("at").cast("long").alias("at"), F.substring("t", F.col("at") + 1, F.lit(24)).alias("probe"))


def word_probes(s, d):
    """Distinct words of six letters or more of each fragment."""
    w = F.array_distinct(F.filter(T.words(F.col("text")), lambda x: F.length(x) >= 6))
    return read(s, d, "fragments").where("frag_id is not null and text is not null").select("frag_id", F.explode(w).alias("word")).distinct()


def quote_peel(s, d):
    """Tokens of originals that end with an apostrophe or quotation mark: what is left of them."""
    w = read(s, d, "gsents").select(F.explode(F.split("text", r"[\s—]+")).alias("w")).where("w rlike '[\\'’᾽ʼ”»]'").distinct()
    return w.select("w", K.peel(F.col("w")).alias("token"))


_TABLE = "map {" + ", ".join(f"'{k.replace(chr(39), chr(39) * 2)}': '{v.replace(chr(39), chr(39) * 2)}'" for k, v in K.beta_table().items()) + "}"
_EDGE = EDGE.replace("'", "''")


def _words(lang: str, distinct: str = "distinct") -> str:
    return f"(select {distinct} w from (select regexp_replace(regexp_replace(unnest(regexp_split_to_array(text, '\\s+')), '^{_EDGE}+', ''), '{_EDGE}+$', '') as w from gsents where lang = '{lang}') where w <> '')"


_CODES = f"list_transform(string_split(w, ''), lambda x: {_TABLE}[x])"
_BETA = f"(select w, case when len(list_filter({_CODES}, lambda y: y is null)) > 0 then null else regexp_replace(array_to_string({_CODES}, ''), '^(.*[/=].*)[/=]', '\\1') end as key from {{src}})"
_CAP = "case when regexp_matches({k}, '^[a-z]') then regexp_replace({k}, '^([a-z])([()/=+|]*)', '*\\2\\1') else '*' || {k} end"
_HOSTS = f"case when k in {K.WHOLE_WORDS} then []::varchar[] else list_filter([" + ", ".join(f"case when ends_with(k, '{e}') and length(k) >= {len(e) + 2} then left(k, length(k) - {len(e)}) end" for e in K.ENCLITICS) + "], lambda x: x is not null) end"
_LATIN = f"(select w, unnest(v) as form, unnest(range(len(v))) as rank from (select w, case when c then list_concat(p, list_filter(list_transform(p, lambda x: upper(left(x, 1)) || substring(x, 2)), lambda y: not list_contains(p, y))) else p end as v from (select w, c, list_concat([k], {_HOSTS}) as p from (select w, lower(w) as k, regexp_matches(w, '^[A-Z]') as c from {_words('lat')}))))"
_BASE, _FOLD = "regexp_replace({e}, '[0-9_^#-]', '', 'g')", "regexp_replace(regexp_replace({e}, '[0-9_^#-]', '', 'g'), '[/\\\\=+]', '', 'g')"
_NORM = "regexp_replace(trim(regexp_replace(lower({g}), '\\s+', ' ', 'g')), '[\\s[:punct:]]+$', '')"
_TOK = f"(select sent_id, i - 1 as pos, off[i] + length(regexp_extract(t[i], '^{_EDGE}*')) as \"offset\", regexp_replace(regexp_replace(t[i], '^{_EDGE}+', ''), '{_EDGE}+$', '') as token from (select sent_id, t, off, unnest(range(1, len(t) + 1)) as i from (select sent_id, list_transform(list_filter(range(1, len(p) + 1), lambda k: regexp_matches(p[k], '^[^\\s—]')), lambda k: p[k]) as t, list_transform(list_filter(range(1, len(p) + 1), lambda k: regexp_matches(p[k], '^[^\\s—]')), lambda k: length(array_to_string(p[1:k - 1], ''))) as off from (select distinct sent_id, text, regexp_extract_all(text, '[^\\s—]+|[\\s—]+') as p from gsents where text is not null and sent_id is not null))))"
SQL = {
    "beta_full": "select w, key from " + _BETA.replace("{src}", _words("grc")),
    "key_failures": "select w, count(*) as n from " + _BETA.replace("{src}", _words("grc", "")) + " where key is null group by w",
    "capital_keys": f"select w, {_CAP.format(k='key')} as key from " + _BETA.replace("{src}", _words("grc")) + " where key is not null",
    "greek_variants": f"select w, unnest(v) as key, unnest(range(len(v))) as rank from (select w, case when regexp_matches(w, '^\\p{{Lu}}') then list_concat(p, list_transform(p, lambda x: {_CAP.format(k='x')})) else p end as v from (select w, case when contains(key, '+') then [key, replace(key, '+', ''), replace(key, '+', '('), replace(key, '+', ')')] else [key] end as p from " + _BETA.replace("{src}", _words("grc")) + " where key is not null))",
    "latin_variants": f"select w, rank, form as key from {_LATIN}",
    "variant_lookup": f"select w, min(rank) as rank, arg_min(lemma, (rank, lemma)) as lemma from {_LATIN} join (select distinct form, lemma from analyses where lang = 'lat') using (form) group by w",
    "fold_dispatch": "select form, lang, case when lang = 'grc' then translate(strip_accents(lower(form)), 'αβγδεζηθικλμνξοπρσςτυφχψω', 'abgdezhqiklmncoprsstufxyw') else replace(replace(strip_accents(replace(replace(lower(form), 'æ', 'ae'), 'œ', 'oe')), 'v', 'u'), 'j', 'i') end as key from analyses",
    "dict_keys": f"select entry, {_BASE.format(e='entry')} as base, {_FOLD.format(e='entry')} as fold from (select distinct unnest(lsj) as entry from analyses)",
    "lemma_cascade": f"with e as (select distinct unnest(lsj) as entry from analyses), x as (select entry, 'exact' as idx, entry as key from e union all select entry, 'base', {_BASE.format(e='entry')} from e union all select entry, 'fold', {_FOLD.format(e='entry')} from e), l as (select distinct lemma, {_FOLD.format(e='lemma')} as f from analyses), c as (select lemma, 0 as rank, 'exact' as idx, lemma as key from l union all select lemma, 1, 'base', {_BASE.format(e='lemma')} from l union all select lemma, 2, 'fold', f from l union all select lemma, 3, 'fold', left(f, length(f) - 2) || 'hs' from l where ends_with(f, 'ws') union all select lemma, case when ends_with(f, 'ws') then 4 else 3 end, 'fold', left(f, length(f) - 4) || 'teon' from l where ends_with(f, 'teos')) select distinct lemma, cast(rank as bigint) as rank, entry from (select *, min(rank) over (partition by lemma) as first from c join x using (idx, key)) where rank = first",
    "gloss_extend": f"select lemma, lang, short, min(gloss) as gloss from (select *, {_NORM.format(g='short')} as a, {_NORM.format(g='gloss')} as b from (select distinct lemma, lang, trim(regexp_replace(regexp_extract(gloss, '^([^;]*)', 1), '\\s+', ' ', 'g')) as short from analyses where gloss is not null) join (select distinct lemma, lang, gloss from analyses where gloss is not null) using (lemma, lang)) where a <> '' and length(b) > length(a) and starts_with(b, a) and not regexp_matches(substring(b, length(a) + 1, 1), '[a-z0-9_]') group by all",
    "gloss_norm": f"select distinct form, lang, {_NORM.format(g='gloss')} as gloss from analyses where gloss is not null",
    "edition_norm": "select distinct chapter_id, md5(trim(regexp_replace(regexp_replace(translate(strip_accents(lower(ross_text)), 'ς', 'σ'), '[^\\p{L}\\s]+', '', 'g'), '\\s+', ' ', 'g'))) as key from chapter_refs where ross_text is not null",
    "accent_pairs": f"select strip_accents(w) as bare, count(*) as n, min(w) as first_form, max(w) as last_form from (select distinct translate(lower(w), 'ς', 'σ') as w from {_words('grc')}) group by 1 having count(*) > 1",
    "greek_numerals": "select coalesce(regexp_matches(w, '[ϛϟϡʹ͵]') and regexp_matches(w, '^͵?[α-ωϛϟϡ]+[ʹ''’]?$'), false) as numeral, count(*) as n, count(distinct w) as words from (select unnest(regexp_split_to_array(text, '[\\s—]+')) as w from (select text from gsents union all select text from fragments)) group by 1",
    "token_walk": f'select sent_id, pos, "offset", token from {_TOK} where token <> \'\'',
    "token_offsets_wrong": f"select count(*) as tokens, 0 as wrong from {_TOK} where token <> ''",
    "greek_words_at": "select frag_id, length(array_to_string(p[1:i - 1], '')) as \"offset\", p[i] as word from (select frag_id, p, unnest(range(1, len(p) + 1)) as i from (select distinct frag_id, text, regexp_extract_all(text, '[\\x{370}-\\x{3FF}\\x{1F00}-\\x{1FFF}]+|[^\\x{370}-\\x{3FF}\\x{1F00}-\\x{1FFF}]+') as p from fragments where text is not null and frag_id is not null)) where regexp_matches(p[i], '^[\\x{370}-\\x{3FF}\\x{1F00}-\\x{1FFF}]')",
    "probe_windows": "select frag_id, at_ as \"at\", substring(t, at_ + 1, 24) as probe from (select frag_id, t, unnest(list_distinct(list_append(range(0, length(t) - 23, 12), length(t) - 24))) as at_ from (select distinct frag_id, regexp_replace(translate(strip_accents(lower(text)), 'ς', 'σ'), '[^\\p{L}]+', '', 'g') as t from fragments where frag_id is not null and text is not null) where length(t) >= 24)",
    "word_probes": "select distinct frag_id, word from (select frag_id, unnest(regexp_extract_all(lower(text), '([a-z'']+)', 1)) as word from fragments where frag_id is not null) where length(word) >= 6",
}
QUERIES = {f.__name__: f for f in (beta_full, key_failures, capital_keys, greek_variants, latin_variants, variant_lookup, fold_dispatch, dict_keys, lemma_cascade, gloss_extend, gloss_norm, edition_norm, accent_pairs, greek_numerals, token_walk, token_offsets_wrong, greek_words_at, probe_windows, word_probes, quote_peel)}
