r"""SQL that gives the same rows as the queries, written for an engine without look-behind, Unicode \b or callbacks.

A query's SQL is a chain of common table expressions; ``chain`` puts those it needs in order. The parser's state machine and
the greedy matching of Jaro-Winkler are recursive: one step a line, one step a letter. Patterns run over a shadow of the
text of equal length, in which letters and digits beyond ASCII are '_', Bangla digits ASCII digits and all white space
blanks, so that ASCII classes see what Unicode classes would; the offsets of the shadow's matches then cut the text.
"""

from __future__ import annotations

from ..functions import fixed as X
from ..functions import keys as K
from ..schemas import HEADER_FIELDS, SECTION_FIELDS, TEXT_FIELDS

SPACES = r"\s\v\x{1c}-\x{1f}\x{85}\p{Z}"
BANGLA = "০১২৩৪৫৬৭৮৯"


def unicode(pattern: str) -> str:
    """A pattern with \\s, \\d and \\w as Unicode classes."""
    out, inside, k = "", False, 0
    classes = {"s": SPACES, "d": r"\p{Nd}", "w": r"\p{L}\p{N}_"}
    while k < len(pattern):
        two = pattern[k : k + 2]
        if two[0] == "\\" and two[1:] in classes:
            out += classes[two[1]] if inside else f"[{classes[two[1]]}]"
        elif two[0] == "\\":
            out += two
        else:
            inside = two[0] == "[" or inside and two[0] != "]"
            out += two[0]
        k += 2 if two[0] == "\\" else 1
    return out


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def stripped(c: str) -> str:
    return f"regexp_replace({c}, '^[{SPACES}]+|[{SPACES}]+$', '', 'g')"


def joined(parts: list[str], by: str) -> str:
    return f"array_to_string(list_filter([{', '.join(parts)}], lambda x: x is not null), {quoted(by)})"


def hmac(domain: str, value: str, n: int) -> str:
    inner, outer = K.PUBLIC_TEST_KEY.pads()
    message = f"encode('{domain}' || chr(31) || {value})"
    return f"substr(sha256(unhex('{outer.hex()}') || unhex(sha256(unhex('{inner.hex()}') || {message}))), 1, {n})"


def titles() -> str:
    return ", ".join(quoted(t) for t in X.TITLES)


def name_tokens(name: str) -> str:
    return f"list_filter(regexp_extract_all(lower(coalesce({name}, '')), '[a-z]+'), lambda t: length(t) > 1 and t not in ({titles()}))"


def masked(name: str) -> str:
    once = "array_to_string(list_transform(list_filter(range(1, length(t) + 1), lambda i: i = 1 or substr(t, i, 1) <> substr(t, i - 1, 1)), lambda i: substr(t, i, 1)), '')"
    mask = f"substr({once}, 1, 1) || regexp_replace(substr({once}, 2), '[aeiouyhw]', '', 'g')"
    return f"coalesce(array_to_string(list_sort(list_transform({name_tokens(name)}, lambda t: {mask})), ' '), '')"


def name_norm(name: str) -> str:
    return f"coalesce(array_to_string(list_sort({name_tokens(name)}), ' '), '')"


def year_bin(y: str) -> str:
    return f"coalesce(({y} - ({y} % 5))::varchar || '-' || ({y} - ({y} % 5) + 4)::varchar, 'NA')"


def digits(c: str) -> str:
    return f"translate({c}, '{BANGLA}', '0123456789')"


def age_years(c: str) -> str:
    number, unit = (f"regexp_extract({digits(c)}, '(\\d+(?:\\.\\d+)?)[{SPACES}]*([A-Za-z]*)', {g})" for g in (1, 2))
    v = f"try_cast(nullif({number}, '') as double)"
    y = f"case when lower({unit}) like 'm%' and lower({unit}) not like 'mi%' then {v} / 12 when lower({unit}) like 'd%' then {v} / 365.25::double when lower({unit}) like 'w%' then {v} / 52.18::double else {v} end"
    return f"case when {y} between 0 and 120 then {y} end"


def age_out(y: str) -> str:
    return f"case when {y} is null then '' when floor({y}) >= 90 then '90+' else floor({y})::bigint::varchar end"


def age_band(y: str) -> str:
    low = f"(floor({y})::bigint - floor({y})::bigint % 5)"
    return f"case when {y} is null then '' when floor({y}) >= 90 then '90+' else {low}::varchar || '-' || ({low} + 4)::varchar end"


def sex(c: str) -> str:
    s = f"lower(regexp_replace(coalesce({c}, ''), '^[{SPACES}]+', ''))"
    return f"case when {s} like 'm%' then 'M' when {s} like 'f%' then 'F' else 'U' end"


def exam_class(e: str, technique: str, title: str) -> dict[str, str]:
    e, t, h = (f"lower(coalesce({c}, ''))" for c in (e, technique, title))
    hit = lambda c, p: f"regexp_matches({c}, {quoted(unicode(p))})"
    both = f"({e} || ' ' || {t})"
    regions = " || ".join(f"case when {hit(e, p)} then '{n};' else '' end" for n, p in X.REGIONS.items())
    return {
        "modality": f"case when contains({e}, 'hrct') then 'HRCT' when {hit(e, X.MODALITY_CTA)} then 'CT angiography' when {hit(e, X.MODALITY_MRI)} then 'MRI' when {hit(e, X.MODALITY_CT)} then 'CT' when {hit(f'({e} || chr(32) || {h})', X.MODALITY_XRAY)} then 'X-ray' when {hit(h, X.MODALITY_CT[:6])} then 'CT' else 'other' end",
        "contrast": f"case when {hit(both, X.CONTRAST_WITH)} then 'with contrast' when {hit(both, X.CONTRAST_WITHOUT)} then 'without contrast' else 'unspecified' end",
        "body_region": f"coalesce(nullif(rtrim({regions}, ';'), ''), 'unspecified')",
    }


def id_number(c: str) -> str:
    return f"nullif(regexp_replace({c}, '[{SPACES}]+', '', 'g'), '')"


def birth_year(day: str, age: str) -> str:
    return f"trunc(year({day}) + dayofyear({day}) / 365.25::double - {age} - 0.5::double)::int"


FOLDER_DAY = r"case when regexp_full_match(folder, '\d{1,2}-\d{1,2}-\d{4}') then try_strptime(folder, '%d-%m-%Y')::date end"
STEM = r"regexp_replace(regexp_extract(path, '([^/]*)/*$', 1), '(.)\.[^.]+$', '\1')"
STEM_TOKENS = f"list_transform(regexp_extract_all(coalesce({STEM}, ''), '[A-Za-z]{{2,}}'), lambda t: lower(t))"
HAS_AUTHOR = "coalesce(meta['author'], '') <> '' or coalesce(meta['last_saved_by'], '') <> ''"


# --- parser ------------------------------------------------------------------------------------

_LABEL_FIELDS = (("idno%", "id_no"), ("reg%", "id_no"), ("patient%", "patient_name"), ("name%", "patient_name"), ("m%", "patient_name"), ("date%", "date"), ("age%", "age"), ("sex%", "sex"), ("gender%", "sex"))
_SECTIONS = (("clinical%", "clinical_information"), ("history%", "clinical_information"), ("technique%", "technique"), ("finding%", "findings"), ("impression%", "impression"), ("conclusion%", "impression"), ("opinion%", "impression"))


def _by_like(c: str, rules, other: str) -> str:
    return "case " + " ".join(f"when {c} like '{p}' then '{f}'" for p, f in rules) + f" else '{other}' end"


def _parser() -> list[str]:
    heading = quoted("(?i)" + unicode(rf"{X.BULLET}({X.SECTION_WORDS})\s*(?:[:\-–]\s*(.*)|)$"))
    label = quoted("(?i)(^|[^A-Za-z])" + unicode(X.HEADER_LABEL.removeprefix("(?<![A-Za-z])")))
    marked = "tabbed"
    for _ in range(2):  # the letter before a label is taken by the match; labels that touch need a second pass
        marked = f"regexp_replace({marked}, {label}, '\\1' || chr(30) || '\\2' || chr(29), 'g')"
    value = f"array_to_string(list_filter(list_transform(string_split(split_part(p, chr(29), 2), chr(9)), lambda c: {stripped('c')}), lambda c: c <> ''), ' ')"
    first = lambda f: f"coalesce(h.\"{f}\", list_filter(l.pairs, lambda x: x.f = '{f}' and x.v <> '')[1].v)"
    new = {f: f"case when l.opens or l.titles and h.title is null then h.\"{f}\" when len(l.pairs) = 0 and h.awaited = '{f}' then l.text" + (f" when len(l.pairs) = 0 and h.awaited is null and h.examined is null and regexp_matches(l.text, {quoted('(?i)' + X.UNLABELLED_EXAM)}) then l.text" if f == "examined" else "") + f" else {first(f)} end" for f in HEADER_FIELDS}
    last_empty = " or ".join(f"l.pairs[-1].f = '{f}' and ({first(f)}) is null" for f in HEADER_FIELDS)
    columns = ", ".join(f'"{f}"' for f in HEADER_FIELDS)
    return [
        f"""p_files as (select file_index, text from source_files where coalesce(error, '') = '' and {stripped("coalesce(text, '')")} <> '')""",
        r"p_rows as (select file_index, unnest(a) as row, generate_subscripts(a, 1) as k from (select file_index, regexp_split_to_array(text, '\r\n|[\n\r\v\f\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]') as a from p_files))",
        f"""p_cells as (select file_index, k, list_filter(list_transform(regexp_split_to_array(row, '[|\\t\\x{{07}}\\x{{fffd}}]'), lambda c: {stripped("c")}), lambda c: c <> '') as cells from p_rows)""",
        """p_text as (select file_index, row_number() over (partition by file_index order by k) as n, array_to_string(cells, ' ') as text, array_to_string(cells, chr(9)) as tabbed from p_cells where len(cells) > 0)""",
        f"""p_marked as (select *, {marked} as marked, regexp_extract(text, {heading}, 1) as word, {stripped(f"regexp_extract(text, {heading}, 2)")} as rest from p_text)""",
        f"""p_lines as (select file_index, n, text, rest, word <> '' as opens, {_by_like("lower(word)", _SECTIONS, "advice")} as section, regexp_matches(text, '(^|[^\\p{{L}}\\p{{N}}_])REPORT($|[^\\p{{L}}\\p{{N}}_])') and text = upper(text) as titles, regexp_matches(text, {quoted("(?i)" + unicode(X.SIGNATURE))}) as signed,
          list_transform(string_split(marked, chr(30))[2:], lambda p: {{'f': {_by_like("regexp_replace(lower(split_part(p, chr(29), 1)), '[^a-z]', '', 'g')", _LABEL_FIELDS, "examined")}, 'v': {value}}}) as pairs from p_marked)""",
        f"""p_header as (select file_index, 1::bigint as n, null::varchar as title, {", ".join(f'null::varchar as "{f}"' for f in HEADER_FIELDS)}, null::varchar as awaited, false as done, 0::bigint as used from p_files
          union all select h.file_index, h.n + 1, case when l.opens then h.title when h.title is null and l.titles then l.text else h.title end, {", ".join(new.values())},
            case when l.opens or h.title is null and l.titles then h.awaited when len(l.pairs) > 0 then case when {last_empty} then l.pairs[-1].f end end,
            l.opens or not (h.title is null and l.titles) and ({new["examined"]}) is not null and not (len(l.pairs) > 0 and ({last_empty})), case when l.opens then h.n - 1 else h.n end
          from p_header h join p_lines l on l.file_index = h.file_index and l.n = h.n where not h.done and h.n <= {X.HEADER_LINES})""",
        f"p_head as (select * exclude (n) from (select *, row_number() over (partition by file_index order by n desc) as last from p_header) where last = 1)",
        """p_body as (select file_index, used + 1 as n, 'technique' as section, false as concluded, null::varchar as stop, null::varchar as said from p_head
          union all select b.file_index, b.n + 1, case when not l.signed and l.opens then l.section else b.section end, b.concluded or not l.signed and l.opens and l.section = 'impression',
            case when b.concluded and l.signed then 'signature' when b.concluded and l.titles then 'new_report' when b.concluded and l.opens and l.section <> 'advice' then 'template_appendix' end,
            case when l.signed then null when l.opens then nullif(l.rest, '') when b.concluded or b.section <> 'technique' or len(l.pairs) = 0 then l.text end
          from p_body b join p_lines l on l.file_index = b.file_index and l.n = b.n where b.stop is null)""",
        "p_parts as (select file_index, section, string_agg(said, chr(10) order by n) as text from p_body where said is not null and stop is null group by file_index, section)",
        f"""p_stop as (select file_index, coalesce(max(stop), 'end_of_document') as stop_reason from p_body group by file_index)""",
        f"""p_sections as (select file_index, {", ".join(f"coalesce({stripped(f'''max(p_parts.text) filter (section = '{s}')''')}, '') as {s}" for s in SECTION_FIELDS)} from p_files left join p_parts using (file_index) group by file_index)""",
        f"""parsed as (select f.file_index, h.title, {", ".join(f'h."{f}"' for f in HEADER_FIELDS)}, {", ".join(f"coalesce(s.{s}, '') as {s}" for s in SECTION_FIELDS)},
          case when h.file_index is null then 'extraction_failed' else {joined(["case when h.id_no is null and h.patient_name is null then 'no_header' end", "case when s.impression = '' then 'no_impression' end", "case when s.findings = '' then 'no_findings' end"], ";")} end as warnings, coalesce(t.stop_reason, 'n/a') as stop_reason
          from source_files f left join p_head h using (file_index) left join p_sections s using (file_index) left join p_stop t using (file_index))""",
    ]


# --- dates -------------------------------------------------------------------------------------


def _dates(source: str) -> list[str]:
    """days(s, day): the date each distinct text names. source: a query of texts s."""
    part = lambda p, g, c="t": f"nullif(regexp_extract({c}, {quoted(unicode(p))}, {g}), '')"
    number = lambda c: f"try_cast({c} as int)"
    year = lambda c: f"case when {number(c)} < 100 then {number(c)} + 2000 else {number(c)} end"
    day = lambda y, m, d: f"case when {y} >= 1 then try_strptime(lpad(({y})::varchar, 4, '0') || '-' || ({m})::varchar || '-' || ({d})::varchar, '%Y-%m-%d')::date end"
    a, b, c, d = X.DATE_DAY_MONTH_YEAR, X.DATE_MONTH_DAY_YEAR, X.DATE_ISO, X.DATE_NUMERIC
    return [
        f"d_texts as (select s, {digits('s')} as t from (select distinct s from ({source}) where s is not null))",
        "d_names(k, m) as (values " + ", ".join(f"({k}, '{m}')" for k, m in enumerate(X.MONTHS, 1)) + ")",
        f"d_words as (select distinct lower(w) as w from (select {part(a, 2)} as w from d_texts union select {part(b, 1)} from d_texts) where w is not null)",
        # closeness as the share of letters in common blocks: the longest first, then left and right of it
        "d_blocks as (select w, k, i, j, n from d_words, d_names, range(1, length(m) + 1) x(i), range(1, length(w) + 1) y(j), range(1, length(m) + 1) z(n) where left(w, 3) not in (select left(m, 3) from d_names) and i + n <= length(m) + 1 and j + n <= length(w) + 1 and substr(m, i, n) = substr(w, j, n))",
        """d_common as (select w, k, 1 as a0, length(m) + 1 as a1, 1 as b0, length(w) + 1 as b1, 0 as n from d_words, d_names where left(w, 3) not in (select left(m, 3) from d_names)
          union all select w, k, side.a0, side.a1, side.b0, side.b1, side.n from (
            select w, k, unnest([{'a0': a0, 'a1': i, 'b0': b0, 'b1': j, 'n': len}, {'a0': i + len, 'a1': a1, 'b0': j + len, 'b1': b1, 'n': 0}]) as side from (
              select c.w, c.k, c.a0, c.a1, c.b0, c.b1, x.i, x.j, x.n as len, row_number() over (partition by c.w, c.k, c.a0, c.a1, c.b0, c.b1 order by x.n desc, x.i, x.j) as best
              from d_common c join d_blocks x on x.w = c.w and x.k = c.k and x.i >= c.a0 and x.i + x.n <= c.a1 and x.j >= c.b0 and x.j + x.n <= c.b1) where best = 1))""",
        f"d_near as (select w, arg_max(k, (r, m)) as k from (select c.w, c.k, m, 2 * sum(n)::double / (length(m) + length(c.w)) as r from d_common c join d_names using (k) group by c.w, c.k, m) where r >= {X.MONTH_CUTOFF} group by w)",
        "d_months as (select w, coalesce((select k from d_names where left(m, 3) = left(w, 3)), (select k from d_near z where z.w = d_words.w)) as k from d_words)",
        f"""d_read as (select s, t, ma.k as month_a, mb.k as month_b from d_texts left join d_months ma on ma.w = lower({part(a, 2)}) left join d_months mb on mb.w = lower({part(b, 1)}))""",
        f"""days as (select s, coalesce({day(year(part(a, 3)), "month_a", number(part(a, 1)))}, {day(number(part(b, 3)), "month_b", number(part(b, 2)))}, {day(number(part(c, 1)), number(part(c, 2)), number(part(c, 3)))}, {day(year(part(d, 3)), number(part(d, 2)), number(part(d, 1)))}) as day from d_read)""",
    ]


def _records() -> list[str]:
    cls = exam_class("p.examined", "p.technique", "p.title")
    return [
        *_parser(),
        f"uids as (select file_index, {hmac('file', 'sha256', 20)} as uid, file_index = min(file_index) over (partition by sha256) as first from source_files)",
        *_dates("select \"date\" as s from parsed"),
        f"""rec0 as (select u.uid, f.file_index, f.path, f.rel, f.meta, p.*exclude (file_index), d.day as header_day, {FOLDER_DAY} as folder_day, {age_years('p.age')} as years, {sex('p.sex')} as sex_code, {id_number('p.id_no')} as number, {masked('p.patient_name')} as mask, {name_norm('p.patient_name')} as norm, {", ".join(f"{v} as {k}" for k, v in cls.items())}
          from uids u join source_files f using (file_index) join parsed p using (file_index) left join days d on d.s = p."date" where u.first)""",
        f"rec1 as (select *, coalesce(header_day, folder_day) as report_date, {birth_year('coalesce(header_day, folder_day)', 'years')} as born from rec0)",
        f"""recs as (select uid, file_index, path, rel, meta, title, patient_name, age as age_raw, examined, {", ".join(SECTION_FIELDS)}, stop_reason, report_date, years as age, sex_code as sex, born as birth_year, number as id_no, {hmac('idno', 'number', 32)} as id_hash, norm as name_norm, mask as masked_name, {hmac('ksrl:name', 'mask', 32)} as name_part, {hmac('ksrl:demo', f"(sex_code || {year_bin('born')})", 32)} as demo_part,
          len(list_filter(string_split(mask, ' '), lambda t: t <> ''))::int as n_tokens, modality, contrast, body_region,
          {joined(["nullif(warnings, '')", "case when header_day is null then 'header_date_unparsed' when abs(header_day - folder_day) > 7 then 'header_date_differs_from_folder' end", "case when years is null then 'age_unparsed' end"], ";")} as warnings from rec1)""",
    ]


# --- linkage -----------------------------------------------------------------------------------

RECS = "(select distinct uid, name_part, n_tokens, name_norm, sex, birth_year, id_hash from linkage_records)"


def _linkage() -> list[str]:
    """pass1, roots, similar, review(a, b, reason)."""
    return [
        f"r as {RECS}",
        """pairs1 as (select a.uid as a, b.uid as b, case when a.id_hash = b.id_hash then 'same_id_no' when abs(a.birth_year - b.birth_year) is null then 'same_name_missing_age'
          when abs(a.birth_year - b.birth_year) <= 1 and a.n_tokens >= 2 then 'same_name_near_age' when abs(a.birth_year - b.birth_year) <= 1 then 'single_token_name'
          when abs(a.birth_year - b.birth_year) = 2 then 'same_name_birth_year_differs' end as reason
          from r a join r b on a.name_part = b.name_part and a.sex = b.sex and a.uid < b.uid where a.n_tokens > 0 and b.n_tokens > 0)""",
        "pass1 as (select a, b, reason, case when reason in ('same_id_no', 'same_name_near_age') then 'merge' else 'review' end as action from pairs1 where reason is not null)",
        "merges as (select a, b from pass1 where action = 'merge' union select b, a from pass1 where action = 'merge')",
        "reach1(uid, hop) as (select uid, uid from r union select reach1.uid, e.b from reach1 join merges e on e.a = reach1.hop)",
        "roots as (select uid, min(hop) as root from reach1 group by uid)",
    ]


def _similar() -> list[str]:
    """similar(sex, name_part_a, name_norm_a, name_part_b, name_norm_b, score): Jaro-Winkler with fractional half transpositions."""
    return [
        "nv as (select distinct sex, name_part, name_norm from linkage_records where name_norm <> '')",
        "np as (select x.sex, x.name_part as name_part_a, x.name_norm as name_norm_a, y.name_part as name_part_b, y.name_norm as name_norm_b from nv x join nv y on x.sex = y.sex and left(x.name_norm, 1) = left(y.name_norm, 1) and x.name_part <> y.name_part and (x.name_norm, x.name_part) < (y.name_norm, y.name_part))",
        """jw as (select distinct name_norm_a as a, name_norm_b as b, 1 as i, []::bigint[] as taken, '' as hits from np
          union all select a, b, i + 1, case when j is null then taken else list_append(taken, j) end, case when j is null then hits else hits || substr(a, i, 1) end from (
            select *, list_filter(range(1, length(b) + 1), lambda j: not list_contains(taken, j) and abs(i - j) <= greatest(length(a), length(b)) // 2 - 1 and substr(b, j, 1) = substr(a, i, 1))[1] as j from jw where i <= length(a)))""",
        """jm as (select a, b, len(taken)::double as m, len(list_filter(range(1, len(taken) + 1), lambda x: substr(hits, x, 1) <> substr(b, list_sort(taken)[x], 1)))::double as crossed,
          case when left(a, 1) <> left(b, 1) then 0 when left(a, 2) <> left(b, 2) or least(length(a), length(b)) < 2 then 1 when left(a, 3) <> left(b, 3) or least(length(a), length(b)) < 3 then 2 when left(a, 4) <> left(b, 4) or least(length(a), length(b)) < 4 then 3 else 4 end as shared from jw where i = length(a) + 1)""",
        "jx as (select a, b, shared, case when a = b then 1.0::double when m = 0 then 0.0::double else (m / length(a) + m / length(b) + (m - crossed / 2) / m) / 3 end as jaro from jm)",
        f"similar_n as (select np.*, case when a = b then 1.0::double else jaro + shared * 0.1::double * (1 - jaro) end as score from np join jx on a = name_norm_a and b = name_norm_b)",
        f"similar_v as (select * from similar_n where score >= {X.SIMILAR_NAME}::double)",
    ]


def _review() -> list[str]:
    return [
        *_linkage(),
        *_similar(),
        "pass2 as (select distinct a.uid as a, b.uid as b, 'same_id_no_different_identity' as reason from r a join r b on a.id_hash = b.id_hash and a.uid < b.uid where a.name_part is distinct from b.name_part or a.sex is distinct from b.sex)",
        "pass12 as (select * from pass2 union all select a, b, reason from pass1 where action = 'review' and (a, b) not in (select (a, b) from pass2))",
        """pass3 as (select distinct least(x.uid, y.uid) as a, greatest(x.uid, y.uid) as b, 'similar_name' as reason from similar_v s
          join r x on x.sex = s.sex and x.name_part = s.name_part_a and x.name_norm = s.name_norm_a join r y on y.sex = s.sex and y.name_part = s.name_part_b and y.name_norm = s.name_norm_b
          join roots rx on rx.uid = x.uid join roots ry on ry.uid = y.uid where coalesce(abs(x.birth_year - y.birth_year), 0) <= 2 and rx.root <> ry.root and (least(x.uid, y.uid), greatest(x.uid, y.uid)) not in (select (a, b) from pass12))""",
        "review as (select * from pass12 union all select * from pass3)",
    ]


def _pending() -> list[str]:
    return [
        *_review(),
        "answers as (select pair_key, max(lower(trim(coalesce(decision, '')))) as decision from linkage_review where pair_key is not null group by pair_key)",
        "keyed as (select a, b, reason, a || '|' || b as pair_key, decision from review left join answers on pair_key = a || '|' || b)",
        "joins2 as (select uid as a, root as b from roots where uid <> root union select root, uid from roots where uid <> root union select a, b from keyed where decision = 'same' union select b, a from keyed where decision = 'same')",
        "reach2(uid, hop) as (select uid, uid from r union select reach2.uid, e.b from reach2 join joins2 e on e.a = reach2.hop)",
        "final_roots as (select uid, min(hop) as root from reach2 group by uid)",
        "pending as (select distinct unnest([a, b]) as uid from keyed k join final_roots x on x.uid = a join final_roots y on y.uid = b where coalesce(decision, '') not in ('same', 'different') and x.root <> y.root)",
    ]


# --- texts -------------------------------------------------------------------------------------

BODY = "concat_ws(chr(10), " + ", ".join(f"nullif({f}, '')" for f in SECTION_FIELDS) + ")"
_TERMS = [
    f"bodies as (select distinct uid, {BODY} as body from parse_report)",
    "vocab as (select word, count(*) as n_docs from (select unnest(list_distinct(regexp_extract_all(lower(body), '[a-z]{2,}'))) as word from bodies) group by word having count(*) >= 3)",
    f"others as (select distinct word from (select unnest(regexp_extract_all(lower(coalesce(patient_name, '')), '[a-z]{{2,}}')) as word from parse_report union all select unnest({STEM_TOKENS}) as word from source_files) where length(word) >= 4 and word not in ({titles()}, {', '.join(map(quoted, X.STOP_WORDS))}) and word not in (select word from vocab))",
    "t_rows as (select p.uid, p.patient_name, f.path, f.meta from (select distinct uid, file_index, patient_name from parse_report) p join source_files f using (file_index))",
    f"t_own as (select uid, unnest({name_tokens('patient_name')}) as word from t_rows union select uid, word from (select uid, unnest({STEM_TOKENS}) as word from t_rows) where word not in ('doc', 'copy') and word not in (select word from vocab))",
    "t_staff as (select distinct uid, lower(word) as word from (select uid, unnest(regexp_extract_all(array_to_string(map_values(meta), ' '), '[A-Za-z]{3,}')) as word from t_rows) where lower(word) not in (select word from vocab))",
    "terms as (select uid, coalesce((select list_sort(list(distinct word)) from t_own o where o.uid = t.uid), []) as own, coalesce((select list_sort(list(distinct word)) from t_staff s where s.uid = t.uid), []) as staff from (select distinct uid from t_rows) t)",
]

SHIFT = "(case when h >= 365 then h - 364 else h - 365 end)::int"
SHIFTS = f"(select p, {SHIFT} as s from (select distinct research_patient_id as p, (('0x' || substr(sha256(research_patient_id), 1, 8))::bigint % 730) as h from identity_map where research_patient_id is not null))"


_WORD = r"\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}\x{200c}\x{200d}"


def shadow(c: str, numbers: bool = True) -> str:
    """The text with ASCII stand-ins of equal length: blanks for white space, '_' for letters, '~' for marks; digits of other
    scripts as digits, or as '_' for patterns that name ASCII digits."""
    spaced = f"regexp_replace({digits(c) if numbers else c}, '[{SPACES}]', ' ', 'g')"
    return rf"regexp_replace(regexp_replace({spaced}, '[^\x{{00}}-\x{{7f}}{_WORD}]', '~', 'g'), '[^\x{{00}}-\x{{7f}}]', '_', 'g')"


NEVER = r"[^\s\S]"
_DATE_PIECE = {
    "a": r"(\d{1,2})(?:st|nd|rd|th)?[\s,.\-/]*([A-Za-z]{3,})[\s,.\-/]*(\d{4}|\d{2})\b",
    "b": r"([A-Za-z]{3,})\s+(\d{1,2})(?:st|nd|rd|th)?,?\s+(\d{4})",
    "c": r"\b(\d{4})-(\d{1,2})-(\d{1,2})\b",
    "d": r"\b(\d{1,2})[./\-](\d{1,2})[./\-](\d{4}|\d{2})\b",
}


def _piece_day(p: str) -> str:
    """The day a matched piece of shadow text names; months by their stem."""
    got = lambda form, g: f"nullif(regexp_extract({p}, {quoted(_DATE_PIECE[form])}, {g}), '')"
    year = lambda c: f"case when {c}::int < 100 then {c}::int + 2000 else {c}::int end"
    stems = "[" + ", ".join(quoted(m[:3]) for m in X.MONTHS) + "]"
    month = lambda c: f"list_position({stems}, lower(left({c}, 3)))"
    day = lambda y, m, d: f"try_strptime(lpad(({y})::varchar, 4, '0') || '-' || ({m})::varchar || '-' || {d}, '%Y-%m-%d')::date"
    return f"coalesce({day(year(got('a', 3)), month(got('a', 2)), got('a', 1))}, {day(got('b', 3), month(got('b', 1)), got('b', 2))}, {day(got('c', 1), got('c', 2), got('c', 3))}, {day(year(got('d', 3)), got('d', 2), got('d', 1))})"


PHONE = X.PHONE.replace(r"\d", "[0-9_]")


def substituted(label: str, pattern: str, by: str, before: str, after: str) -> str:
    """A step over (uid, field, own, id_no, days, text, hits): what the pattern matches in the shadow is replaced in the text."""
    start = "1 + coalesce(list_sum(list_transform(range(1, i), lambda j: length(parts[j]) + length(h[j]))), 0)::bigint"
    return f"""{after} as (select uid, field, own, id_no, days, array_to_string(list_transform(range(1, len(parts) + 1), lambda i: substr(text, {start}, length(parts[i])) || case when i <= len(h) then {by} else '' end), '') as text, list_append(hits, {{'l': '{label}', 'n': len(h)}}) as hits
      from (select *, regexp_split_to_array(sh, pat) as parts, case when text = '' then [] else regexp_extract_all(sh, pat) end as h from (select *, {pattern} as pat, {shadow('text', label != 'phone')} as sh from {before})))"""


def _staged_texts() -> list[str]:
    """s_rows and s0 of the parsed reports."""
    fields = ", ".join(f"{{'f': '{f}', 't': coalesce({'examined' if f == 'exam' else f}, '')}}" for f in TEXT_FIELDS)
    return [
        "ids as (select distinct uid, id_no, research_patient_id, report_id from identity_map)",
        f"s_rows as (select p.uid, i.id_no, i.report_id, t.own, t.staff, x.s as days, p.warnings, [{fields}] as f from (select distinct * from parse_report) p join ids i using (uid) join {SHIFTS} x on x.p = i.research_patient_id join terms t on t.uid = p.uid)",
        "s0 as (select uid, x.f as field, own, id_no, days, x.t as text, [{'l': '', 'n': 0}] as hits from (select uid, own, id_no, days, unnest(f) as x from s_rows))",
    ]


def _released_texts() -> list[str]:
    """s0 of the released reports, with the names and numbers of their patients."""
    fields = ", ".join(f"{{'f': '{f}', 't': coalesce({f}, '')}}" for f in TEXT_FIELDS)
    return [
        f"s_rows as (select r.report_id as uid, i.id_no, {name_tokens('i.patient_name')} as own, x.s as days, [{fields}] as f from (select distinct * from reports) r join (select distinct report_id, id_no, patient_name from identity_map) i using (report_id) join {SHIFTS} x on x.p = r.research_patient_id)",
        "s0 as (select uid, x.f as field, own, id_no, days, x.t as text, [{'l': '', 'n': 0}] as hits from (select uid, own, id_no, days, unnest(f) as x from s_rows))",
    ]


def _document_texts() -> list[str]:
    """s0 of the documents; terms and number are made up from other columns."""
    return ["s0 as (select doc_id as uid, 'text' as field, ['report', 'seen', coalesce(lower(modality), '')] as own, facility_id as id_no, (doc_id % 700 - 350)::int as days, coalesce(text, '') as text, [{'l': '', 'n': 0}] as hits from documents)"]


def _scrub(fields: tuple[str, ...] = TEXT_FIELDS) -> list[str]:
    """scrubbed(uid, the fields, counts as JSON, n_name) from s0, in the order of the steps."""
    names = "list_filter(own, lambda t: length(t) >= 2)"
    by_length = f"array_to_string(list_transform(list_sort(list_transform({names}, lambda t: {{'n': -length(t), 't': t}})), lambda t: t.t), '|')"
    steps = [
        ("clinician", quoted("(?i)" + X.CLINICIAN), "'[CLINICIAN]'"),
        ("clinician", quoted("(?i)" + X.CREDENTIAL), "'[CLINICIAN]'"),
        ("email", quoted(X.EMAIL), "'[EMAIL]'"),
        ("phone", quoted(PHONE), "'[PHONE]'"),
        ("id_no", f"case when length(trim(id_no)) >= 3 then '(?i)\\b' || regexp_escape({shadow('trim(id_no)')}) || '\\b' else '{NEVER}' end", "'[ID]'"),
        ("date", quoted("(?i)" + X.DATE_IN_TEXT), f"coalesce(strftime({_piece_day('h[i]')} + days, '%Y-%m-%d'), '[DATE]')"),
        ("long_number", quoted(X.LONG_NUMBER), "'[NUMBER]'"),
        ("name", f"case when len({names}) > 0 then '(?i)\\b(?:' || {by_length} || ')\\b' else '{NEVER}' end", "'[NAME]'"),
    ]
    labels = ("clinician", "email", "phone", "id_no", "date", "long_number", "name")
    count = lambda label: f"sum(list_sum(list_transform(list_filter(hits, lambda x: x.l = '{label}'), lambda x: x.n)))::bigint"
    json = "'{' || " + joined([f"case when n_{x} > 0 then '\"{x}\":' || n_{x} end" for x in labels], ",") + " || '}'"
    return [
        *(substituted(label, pattern, by, f"s{k}", f"s{k + 1}") for k, (label, pattern, by) in enumerate(steps)),
        f"s_counts as (select uid, {', '.join(f'{count(x)} as n_{x}' for x in labels)}, {', '.join(f'''max(text) filter (field = '{f}') as {f}''' for f in fields)} from s{len(steps)} group by uid)",
        f"scrubbed as (select *, {json} as counts from s_counts)",
    ]


PASS_LAST, FAIL_LAST, OTHER_LAST = "7", "3", "5"
OVERRIDES = f"(select report_id, case right(report_id, 1) when '{PASS_LAST}' then 'pass' when '{FAIL_LAST}' then 'fail' when '{OTHER_LAST}' then 'later' else '' end as decision from ids)"


def pattern_hits(body: str) -> str:
    forms = (("phone", PHONE, ""), ("email", X.EMAIL, ""), ("clinician", X.CLINICIAN, "(?i)"), ("credential", X.CREDENTIAL, "(?i)"), ("long_number", X.LONG_NUMBER, ""))
    return "list_filter([" + ", ".join(f"case when regexp_matches({shadow(body, label != 'phone')}, {quoted(flag + p)}) then '{label}' end" for label, p, flag in forms) + "], lambda x: x is not null)"


def _qa() -> list[str]:
    """checked(uid, report_id, qa_status, decision, issues as a list): pending records and overrides as the query has them."""
    named = lambda label, found: f"case when len({found}) > 0 then '{label}:' || array_to_string({found}, ',') end"
    own = "list_sort(list_filter(own, lambda t: length(t) >= 3 and list_contains(words, t)))"
    staff = "list_sort(list_filter(staff, lambda t: list_contains(words, t)))"
    foreign = "list_sort(list_filter(coalesce(foreign_words, []), lambda t: not list_contains(own, t)))[1:5]"
    parse = "list_transform(list_filter(coalesce(warnings, []), lambda w: w in ('no_header', 'no_impression', 'extraction_failed')), lambda w: 'parse:' || w)"
    single = f"[{named('own_name_token', own)}, case when length(trim(id_no)) >= 3 and regexp_matches({shadow('body')}, '\\b' || regexp_escape({shadow('trim(id_no)')}) || '\\b') then 'id_no_in_text' end]"
    after = f"[{named('metadata_person_token', staff)}, {named('possible_name_token', foreign)}, case when n_name > 0 then 'patient_name_was_in_body_check_scrub' end]"
    last = "[case when findings = '' and impression = '' then 'missing_clinical_content' end, case when uid in (select uid from pending) then 'linkage_pending_review' end]"
    return [
        "q_body as (select s.*, x.id_no, x.report_id, x.own, x.staff, x.warnings, " + " || chr(10) || ".join(f"s.{f}" for f in TEXT_FIELDS) + " as body from scrubbed s join s_rows x using (uid))",
        "q_words as (select *, list_distinct(regexp_extract_all(lower(body), '[a-z]{2,}')) as words from q_body)",
        "q_foreign as (select uid, list(word) as foreign_words from (select uid, unnest(words) as word from q_words) where word in (select word from others) group by uid)",
        f"q_issues as (select uid, report_id, list_filter(list_concat({single}, list_transform({pattern_hits('body')}, lambda p: p || '_pattern'), {after}, {parse}, {last}), lambda x: x is not null) as issues, {', '.join(TEXT_FIELDS)} from q_words left join q_foreign using (uid))",
        f"checked as (select q.*, decision, case when decision = 'pass' then 'passed_override' when decision = 'fail' or len(issues) > 0 then 'failed' else 'passed' end as qa_status from q_issues q join {OVERRIDES} using (report_id))",
    ]


# --- imaging -----------------------------------------------------------------------------------

DAY = "case when regexp_full_match(tags['StudyDate'], '[0-9]{8}') then try_strptime(tags['StudyDate'], '%Y%m%d')::date end"


def _imaging() -> list[str]:
    """linked(file, uid, distance), dicom(file, report_uid, study_id, needs_pixel_review, tags as lines)."""
    h = hmac("dicom-uid", "{}", 30)
    uid = lambda v: "'2.25.' || (('0x' || substr({0}, 1, 15))::bigint::hugeint * 1152921504606846976 + ('0x' || substr({0}, 16, 15))::bigint)::varchar".format(h.format(v))
    quote = lambda xs: ", ".join(map(quoted, xs))
    moved = "coalesce(strftime(case when regexp_full_match(e.value, '[0-9]{8}') then try_strptime(e.value, '%Y%m%d')::date end + s, '%Y%m%d'), e.value)"
    value = f"case when e.key = 'PatientAge' and regexp_full_match(e.value, '[0-9]{{3}}Y') and left(e.value, 3)::int >= 90 then '090Y' when e.key in ({quote(X.DATE_TAGS)}) then {moved} when e.key in ({quote(X.UID_TAGS)}) then {uid('e.value')} else e.value end"
    own = "['PatientName=' || rid, 'PatientID=' || rid, 'PatientIdentityRemoved=YES', " + quoted("DeidentificationMethod=" + X.DEIDENTIFICATION_METHOD) + "]"
    gone = f"e.key in ({quote({*X.REMOVE_TAGS, *X.PERSON_NAME_TAGS, 'PatientID', 'PatientIdentityRemoved', 'DeidentificationMethod'})}) or regexp_matches(e.key, '(?i)^private')"
    return [
        f"""i_studies as (select distinct file, no, day from (select file, unnest([{id_number("tags['PatientID']")}, {id_number("tags['AccessionNumber']")}]) as no, {DAY} as day from dicom_headers) where no is not null and day is not null)""",
        f"i_reports as (select distinct uid, {id_number('id_no')} as no, report_date::date as day from identity_map where report_date is not null)",
        "linked as (select file, uid, distance from (select file, uid, abs(s.day - i.day)::int as distance, row_number() over (partition by file order by abs(s.day - i.day), uid) as k from i_studies s join i_reports i using (no) where abs(s.day - i.day) <= 3) where k = 1)",
        f"i_rows as (select distinct h.file, l.uid, i.research_patient_id as rid, x.s, h.tags from dicom_headers h join linked l using (file) join identity_map i using (uid) join {SHIFTS} x on x.p = i.research_patient_id)",
        f"i_tags as (select file, list('' || e.key || '=' || {value} order by e.key) filter (not ({gone})) as kept from (select file, s, unnest(map_entries(tags)) as e from i_rows) where e.value is not null group by file)",
        f"""dicom as (select file, uid as report_uid, coalesce({uid("tags['StudyInstanceUID']")}, '') as study_id, upper(coalesce(tags['BurnedInAnnotation'], '')) = 'YES' or coalesce(tags['Modality'] in ({quote(X.PIXEL_RISK_MODALITIES)}), false)
          or contains(upper(coalesce(tags['ImageType'], '')), 'SECONDARY') or contains(upper(coalesce(tags['ImageType'], '')), 'SCREEN') as needs_pixel_review, array_to_string(list_sort(list_concat(coalesce(kept, []), {own})), chr(10)) as tags from i_rows left join i_tags using (file))""",
    ]


_PARTS = {"parsed": _parser, "recs": _records, "days": lambda: _dates("select header_date as s from parse_report"), "clusters": _linkage, "similar": _similar, "review": _review, "pending": _pending, "terms": lambda: _TERMS, "scrub": lambda: [*_TERMS, *_staged_texts(), *_scrub()], "scrub_r": lambda: [*_released_texts(), *_scrub()], "scrub_d": lambda: [*_document_texts(), *_scrub(("text",))], "qa": lambda: [*_pending(), *_TERMS, *_staged_texts(), *_scrub(), *_qa()], "imaging": _imaging}


def chain(parts: str, final: str, *extra: str) -> str:
    """'with recursive' the tables of the named parts (blanks between; a table needed twice stands once), then ``extra`` tables, then the query."""
    tables: dict[str, None] = {}
    for part in parts.split():
        tables |= dict.fromkeys(_PARTS[part]())
    return "with recursive " + ",\n".join([*tables, *extra]) + "\n" + final
