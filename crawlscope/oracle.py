"""DuckDB SQL for the audit queries, from shared common table expressions."""

from __future__ import annotations

from html.entities import html5

from .sources.derived import oracle_ctes

WS = r"[\x{09}-\x{0D}\x{20}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
CAT = "('c','category','categories','tag','tags','topic','topics')"
GENERATED = "('archive','cluster','category_page','canvas','story','generated')"


def _path(u: str) -> str:
    p = f"regexp_extract({u},'^https?://[^/?#]+([^?#]*)',1)"
    return f"(CASE WHEN {p}='' THEN '/' ELSE {p} END)"


def _search(u: str) -> str:
    return rf"regexp_extract({u},'^[^?#]*(\?[^#]*)',1)"


def _norm(u: str) -> str:
    s = f"regexp_replace({_path(u)},'/+$','')"
    return f"concat(regexp_extract({u},'^(https?://[^/?#]+)',1),CASE WHEN {s}='' THEN '/' ELSE {s} END,{_search(u)})"


def _host(u: str) -> str:
    return f"regexp_extract({u},'^https?://([^/?#]+)',1)"


def _parts(u: str) -> str:
    return f"list_filter(string_split({_path(u)},'/'),lambda x: x<>'')"


def _type(u: str, preview: bool = False) -> str:
    p, q = f"{_parts(u)}[1]", _search(u)
    cat = "'category'" if preview else f"CASE WHEN {q}<>'' THEN 'category_page' ELSE 'category' END"
    paged = "" if preview else f"WHEN regexp_matches({q},'(?i)(^|[?&])page=[0-9]+') THEN 'category_page'"
    return f"""CASE WHEN len({_parts(u)})=0 THEN 'home' WHEN {p} IN ('archive','cluster','canvas') THEN {p}
 WHEN {p} IN ('source','sources') THEN 'source' WHEN {p} IN ('story','stories') THEN 'story'
 WHEN {p} IN {CAT} THEN {cat} {paged} WHEN len({_parts(u)})=1 THEN 'static' ELSE 'generated' END"""


def _section(u: str, preview: bool = False) -> str:
    p0, p1 = f"{_parts(u)}[1]", f"{_parts(u)}[2]"
    if preview:
        return f"coalesce({p0},'home')"
    return f"""CASE WHEN {p0} IS NULL THEN 'home' WHEN {p0} IN {CAT} AND {p1} IS NOT NULL THEN concat({p0},'/',{p1})
 WHEN {p0}='canvas' AND {p1} IS NOT NULL THEN 'canvas/archive' ELSE {p0} END"""


#: White space of Spark's ``\\s``, and a tag's inside: quoted values may hold any character.
SP, INSIDE = r"[\t\n\x0B\f\r ]", """(?:[^>"'']|"[^"]*"|''[^'']*'')*"""
ATTRIBUTE = r"""([^\t\n\x0B\f\r "''<>/=]+)S*=S*("[^"]*"|''[^'']*''|[^\t\n\x0B\f\r "''>]+)""".replace("S*", f"{SP}*")
#: What hides markup; a title is kept.
HIDDEN = rf"(?is)(<title\b{INSIDE}>.*?(?:</title{SP}*>|\z))|<!--.*?(?:--!?>|\z)|" + "|".join(
    rf"<{e}\b{INSIDE}>.*?(?:</{e}[\t\n\x0B\f\r />]|\z)" for e in ("script", "style", "textarea", "xmp", "iframe", "noembed", "noframes")
)
#: The standard's names of entities, and the code points that stand for those of code page 1252; as columns.
NAMED = "(SELECT {names} AS entities, {codes} AS windows)".format(
    names="MAP {" + ",".join("'{}':{}".format(k, "||".join(f"chr({ord(c)})" for c in v)) for k, v in html5.items()) + "}",
    codes="MAP {" + ",".join(f"{c}:{ord(bytes([c]).decode('cp1252'))}" for c in range(0x80, 0xA0) if bytes([c]).decode("cp1252", errors="ignore")) + "}",
)


def _decoded(x: str) -> str:
    """Each ``&`` begins an entity or stands for itself; what is decoded isn't read again."""
    digits = "regexp_extract(p,'^#[xX]?0*([0-9A-Fa-f]*)',1)"
    code = f"CASE WHEN length({digits})>7 OR {digits}='' THEN 0 WHEN p[2] IN ('x','X') THEN concat('0x',{digits})::BIGINT ELSE {digits}::BIGINT END"
    char = f"chr(coalesce(windows[({code})::INT],CASE WHEN ({code})=0 OR ({code})>1114111 OR ({code}) BETWEEN 55296 AND 57343 THEN 65533 ELSE {code} END)::INT)"
    name, number = "regexp_extract(p,'^[A-Za-z][A-Za-z0-9]*;?')", "regexp_extract(p,'^#(?:[0-9]+|[xX][0-9A-Fa-f]+);?')"
    one = f"CASE WHEN {number}<>'' THEN concat({char},substr(p,length({number})+1)) WHEN entities[{name}] IS NOT NULL THEN concat(entities[{name}],substr(p,length({name})+1)) ELSE concat('&',p) END"
    return f"concat(string_split({x},'&')[1],array_to_string(list_transform(string_split({x},'&')[2:],lambda p: {one}),''))"


def _clean(x: str) -> str:
    return f"nullif(trim(regexp_replace({_decoded(x)},'{WS}+',' ','g')),'')"


def _value(tag: str, name: str) -> str:
    """The first value of an attribute, without its quotes."""
    value = f"regexp_extract_all({tag},'{ATTRIBUTE}',2)[list_position(list_transform(regexp_extract_all({tag},'{ATTRIBUTE}',1),lambda n: lower(n)),'{name}')]"
    return f"""regexp_replace({value},'(?s)^(?:"(.*)"|''(.*)'')$','\\1\\2')"""


def _tag(element: str, name: str, told: str) -> str:
    return f"list_filter(regexp_extract_all(shown,'(?i)<{element}[\\t\\n\\x0B\\f\\r /]{INSIDE}>'),lambda t: {told.format(_value('t', name))})[1]"


def _meta(name: str) -> str:
    return _value(_tag("meta", "name", f"{{}}='{name}'"), "content")


def _link() -> str:
    return _value(_tag("link", "rel", "lower({})='canonical'"), "href")


def _issues(checks: list[tuple[str, str, str, str]]) -> str:
    made = ",".join(
        f"CASE WHEN {cond} THEN {{'ord':{i},'severity':{sev},'code':'{code}','message':{message}}} END" for i, (cond, sev, code, message) in enumerate(checks)
    )
    return f"unnest(list_filter([{made}],lambda x: x IS NOT NULL))"


MILD = f"CASE WHEN page_type IN {GENERATED} THEN 'notice' ELSE 'warning' END"
CANON = "CASE WHEN canonical LIKE 'http%' THEN canonical WHEN canonical LIKE '/%' THEN concat(regexp_extract(url,'^(https?://[^/?#]+)',1),canonical) END"

FULL_CHECKS = [
    ("coalesce(status,0)=0", "'error'", "FETCH_FAILED", "'Page could not be fetched.'"),
    ("status>=400", "'error'", "BAD_STATUS", "concat('Page returned HTTP ',status,'.')"),
    ("status BETWEEN 300 AND 399 AND NOT loop AND n_hops=0", "'warning'", "REDIRECT_STATUS", "concat('Page returned redirect status ',status,'.')"),
    ("loop", "'error'", "REDIRECT_LOOP", "'Sitemap URL enters a redirect loop.'"),
    ("NOT loop AND n_hops>=2", "'warning'", "REDIRECT_CHAIN", "concat('Sitemap URL passes through ',n_hops,' redirects before resolving.')"),
    ("NOT loop AND n_hops=1", "'warning'", "REDIRECTED_URL", "concat('Sitemap URL resolves to ',final_url,'.')"),
    ("title IS NULL", MILD, "MISSING_TITLE", "'Page is missing a <title> tag.'"),
    ("length(title)<15", "'notice'", "SHORT_TITLE", "'Title is very short.'"),
    ("length(title)>75", MILD, "LONG_TITLE", "'Title may be too long for search results.'"),
    ("description IS NULL", MILD, "MISSING_META_DESCRIPTION", "'Page is missing a meta description.'"),
    ("length(description)<50", "'notice'", "SHORT_META_DESCRIPTION", "'Meta description is short.'"),
    ("length(description)>180", MILD, "LONG_META_DESCRIPTION", "'Meta description may be too long.'"),
    ("canonical IS NULL", "'notice'", "MISSING_CANONICAL", "'Page is missing a canonical link.'"),
    (f"canon IS NOT NULL AND {_host('canon')}<>{_host('url')}", "'warning'", "CANONICAL_CROSS_HOST", "concat('Canonical points to another host: ',canon,'.')"),
    (f"canon IS NOT NULL AND {_host('canon')}={_host('url')} AND {_norm('canon')}<>{_norm('url')} AND {_norm('canon')} IS DISTINCT FROM {_norm('final_url')}", "'notice'", "CANONICAL_MISMATCH", "concat('Canonical points to a different URL: ',canon,'.')"),
    ("noindex", "'error'", "NOINDEX_IN_SITEMAP", "'Page appears in sitemap but has a noindex robots directive.'"),
    ("lastmod IS NULL", MILD, "MISSING_LASTMOD", "'Sitemap entry is missing lastmod.'"),
]

START = f"WITH RECURSIVE {oracle_ctes()},\n"

#: Pages as derived: no redirects.
PLAIN = "entries AS (SELECT *, NULL::VARCHAR AS final_url, 0 AS n_hops, false AS loop FROM crawl QUALIFY row_number() OVER (PARTITION BY site, url ORDER BY page_id) = 1),\n"

PAGES = f"""meta0 AS (SELECT site, url, lastmod, status, final_url, n_hops, loop,
  {_clean(f"regexp_extract(shown,'(?is)<title\\b{INSIDE}>(.*?)(?:</title{SP}*>|\\z)',1)")} AS title,
  {_clean(_meta('description'))} AS description, {_clean(_link())} AS canonical,
  coalesce(contains(lower({_clean(_meta('robots'))}),'noindex'),false) AS noindex,
  {_path('url')} AS path, concat({_path('url')},{_search('url')}) AS display_path,
  {_section('url')} AS section, {_type('url')} AS page_type FROM (SELECT *, regexp_replace(html,'{HIDDEN}','\\1','g') AS shown FROM entries), {NAMED} named),
meta AS (SELECT *, {CANON} AS canon FROM meta0),
checks AS (SELECT site, url, unnest(x) FROM (SELECT site, url, {_issues(FULL_CHECKS)} AS x FROM meta)),
scored AS (SELECT *, CASE WHEN canon IS NOT NULL THEN {_norm('canon')} ELSE {_norm('coalesce(final_url,url)')} END AS k,
  (title IS NOT NULL)::INT*3+(description IS NOT NULL)::INT*2+(lastmod IS NOT NULL)::INT+coalesce((status=200)::INT,0)*2 AS sc FROM meta),
ranked AS (SELECT *, row_number() OVER (PARTITION BY site,k ORDER BY sc DESC,url) AS n FROM scored),
kept AS (SELECT * FROM ranked WHERE n=1),
dup_t AS (SELECT site,url,CASE WHEN page_type IN ('cluster','archive','category_page','canvas','generated') THEN 'notice' ELSE 'warning' END AS severity,
  'DUPLICATE_TITLE' AS code,'Title is duplicated on another indexed page.' AS message FROM kept
  WHERE title IS NOT NULL QUALIFY count(*) OVER (PARTITION BY site,lower(title))>1),
dup_d AS (SELECT site,url,'notice' AS severity,'DUPLICATE_META_DESCRIPTION' AS code,'Meta description is duplicated on another indexed page.' AS message FROM kept
  WHERE description IS NOT NULL QUALIFY count(*) OVER (PARTITION BY site,lower(description))>1),
rlines AS (SELECT site, generate_subscripts(l,1) AS pos, unnest(l) AS raw FROM (SELECT site, string_split(body,chr(10)) AS l FROM robots_txt)),
rfields AS (SELECT site,pos,lower(trim(regexp_extract(line,'^([^:]*):',1))) AS field,trim(regexp_extract(line,'^[^:]*:(.*)$',1)) AS value
  FROM (SELECT site,pos,trim(regexp_replace(raw,'#.*$','')) AS line FROM rlines) WHERE contains(line,':')),
rblocks AS (SELECT *, sum(opens) OVER (PARTITION BY site ORDER BY pos) AS block FROM (
  SELECT *, (field='user-agent' AND coalesce(lag(field) OVER (PARTITION BY site ORDER BY pos),'')<>'user-agent')::INT AS opens
  FROM rfields WHERE field IN ('user-agent','allow','disallow'))),
ragents AS (SELECT DISTINCT site,block,lower(value) AS ua FROM rblocks WHERE field='user-agent'),
rrules AS (SELECT site,ua,pos-1 AS rule_pos,field='allow' AS allow,value AS pattern,length(value)::INT AS len,
  concat('^',replace(regexp_replace(CASE WHEN value LIKE '%$' THEN substr(value,1,length(value)-1) ELSE value END,'([.+?^${{}}()|\\[\\]\\\\])','\\\\\\1','g'),'*','.*'),CASE WHEN value LIKE '%$' THEN '\\z' ELSE '' END) AS regex
  FROM rblocks JOIN ragents USING (site,block) WHERE field<>'user-agent' AND value<>''),
verdict AS (SELECT e.site,e.url,coalesce(max(len*2+allow::INT) FILTER (WHERE regexp_matches(display_path,regex))%2=1,true) AS allowed
  FROM meta e LEFT JOIN (SELECT * FROM rrules WHERE ua='*') r ON r.site=e.site GROUP BY e.site,e.url),
conflict AS (SELECT k.site,k.url,'warning' AS severity,'ROBOTS_DISALLOWED_IN_SITEMAP' AS code,'URL is listed in the sitemap but blocked by robots.txt.' AS message
  FROM kept k JOIN verdict v USING (site,url) WHERE NOT v.allowed),
pissues AS (SELECT c.site,c.url,0 AS stage,ord,severity,code,message FROM checks c SEMI JOIN kept USING (site,url)
  UNION ALL SELECT site,url,1,0,severity,code,message FROM dup_t UNION ALL SELECT site,url,2,0,severity,code,message FROM dup_d
  UNION ALL SELECT site,url,3,0,severity,code,message FROM conflict),
facts AS (SELECT site,count(*) AS n_entries FROM meta GROUP BY site),
dropped AS (SELECT site,count(*) AS dropped FROM ranked WHERE n>1 GROUP BY site),
blocked AS (SELECT site,count(*) AS blocked FROM conflict GROUP BY site),
sissues AS (SELECT site,'warning' AS severity,'SINGLE_URL_SITEMAP' AS code,'Only 1 URL was found in the sitemap inventory. This is thin unless the site is intentionally one page.' AS message FROM facts WHERE n_entries=1
  UNION ALL SELECT site,'warning','THIN_SITEMAP',concat('Only ',n_entries,' URLs were found in the sitemap inventory.') FROM facts WHERE n_entries BETWEEN 2 AND 4
  UNION ALL SELECT site,'warning','MAX_PAGES_LIMIT_REACHED',concat('Checked first 20 pages out of ',n_entries,'.') FROM facts WHERE n_entries>20
  UNION ALL SELECT site,'notice','DUPLICATE_URLS_DEDUPED',concat(dropped,' duplicate-ish sitemap URLs were collapsed in the public index.') FROM dropped
  UNION ALL SELECT site,'warning','ROBOTS_SITEMAP_CONFLICTS',concat(blocked,' sitemap URL(s) are advertised in the sitemap but disallowed by robots.txt.') FROM blocked),
allissues AS (SELECT site,severity,code FROM pissues UNION ALL SELECT site,severity,code FROM sissues),
sev AS (SELECT site,count(*) FILTER (WHERE severity='error') AS errors,count(*) FILTER (WHERE severity='warning') AS warnings,count(*) FILTER (WHERE severity='notice') AS notices FROM allissues GROUP BY site),
w AS (SELECT *,CASE WHEN page_type IN ('home','static') THEN 100 WHEN page_type IN ('category','source') THEN 75 WHEN page_type IN ('category_page','archive','canvas') THEN 35 WHEN page_type IN ('cluster','story','generated') THEN 25 ELSE 50 END AS w FROM kept),
agg AS (SELECT site,count(*) AS n,count(DISTINCT section) AS sections,greatest(sum(w),100)::DOUBLE AS w_all,coalesce(sum(w) FILTER (WHERE title IS NULL),0)::DOUBLE AS w_t,coalesce(sum(w) FILTER (WHERE description IS NULL),0)::DOUBLE AS w_d,coalesce(sum(w) FILTER (WHERE lastmod IS NULL),0)::DOUBLE AS w_l FROM w GROUP BY site)
"""

BASE = START + PLAIN + PAGES

PENALTY = "CASE WHEN n=1 THEN 35 WHEN n BETWEEN 2 AND 4 THEN 20 WHEN n<10 THEN 10 ELSE 0 END"


def _round(x: str) -> str:
    return f"floor({x}+0.5::DOUBLE)"


def _clamp(x: str) -> str:
    return f"greatest(0,least(100,{_round(x)}))::INT"


def _human(c: str) -> str:
    return f"array_to_string(list_transform(string_split(replace({c},'_',' '),' '),lambda x: concat(upper(substr(x,1,1)),substr(x,2))),' ')"


def _recover(body: str) -> str:
    locs = rf"list_transform(regexp_extract_all({body},'(?i)<loc[^>]*>\s*([^<\s]+)\s*</loc>',1),lambda x: replace(x,'&amp;','&'))"
    return f"list_transform({locs},lambda x: {_norm('x')})"


ENTRIES = rf"""
maps AS (SELECT site, body, body LIKE '%</urlset>' AS ok FROM sitemap_xml),
parsed AS (SELECT site, generate_subscripts(l,1) AS i, unnest(l) AS item FROM (SELECT site, regexp_extract_all(body,'<url>.*?</url>') AS l FROM maps WHERE ok)),
found AS (SELECT site, body, generate_subscripts(l,1) AS i, unnest(l) AS url FROM (SELECT site, body, list_filter({_recover('body')},lambda x, i: list_position({_recover('body')},x)=i) AS l FROM maps)),
cand AS (SELECT site, 0 AS recovered, i, {_norm("replace(regexp_extract(item,'<loc>(.*?)</loc>',1),'&amp;','&')")} AS url, nullif(regexp_extract(item,'<lastmod>(.*?)</lastmod>',1),'') AS lastmod FROM parsed
 UNION ALL SELECT site, 1, i, url, CASE WHEN instr(body,url)>0 THEN nullif(regexp_extract(substr(body,greatest(instr(body,url)-1-600,0)+1,instr(body,url)-1+1200-greatest(instr(body,url)-1-600,0)),'(?i)<lastmod[^>]*>\s*([^<\s]+)\s*</lastmod>',1),'') END FROM found),
mapped AS (SELECT site, url, lastmod FROM cand QUALIFY row_number() OVER (PARTITION BY site,url ORDER BY recovered,i)=1)
"""

def _walk(log: str, starts: str) -> str:
    """Redirect walks of the URLs of ``starts`` over ``log``."""
    return f"""
hops AS (SELECT url, status, location AS nxt FROM {log} WHERE status BETWEEN 300 AND 399 AND coalesce(location,'')<>'' QUALIFY row_number() OVER (PARTITION BY url ORDER BY location, status)=1),
walk AS (
 SELECT DISTINCT url AS start_url, url AS cur, []::VARCHAR[] AS visited, 0 AS n, false AS loop FROM {starts}
 UNION ALL
 SELECT start_url, h.nxt, list_append(visited, cur), n+1, list_contains(visited, h.nxt) FROM walk JOIN hops h ON h.url=walk.cur WHERE NOT loop AND n<=10),
ends AS (SELECT * FROM walk QUALIFY row_number() OVER (PARTITION BY start_url ORDER BY n DESC)=1)
"""


WALK = _walk("fetch_log", "crawl")

#: Where the pages of whole audits end, and what is there.
RESOLVED = _walk("site_pages", "once") + """,
resolved AS (SELECT e.start_url, e.cur, e.loop, NOT e.loop AND e.n=11 AS truncated, NOT e.loop AND e.n<11 AND f.status IS NULL AS broken, e.n,
  CASE WHEN e.loop THEN h.status WHEN e.n=11 THEN 310 ELSE f.status END AS status, CASE WHEN e.loop OR e.n=11 THEN '' ELSE f.body END AS html
  FROM ends e LEFT JOIN site_pages f ON f.url=e.cur LEFT JOIN hops h ON h.url=e.visited[len(e.visited)])
"""

#: Entries of the audits' sitemaps, the files in order of their visit.
AUDIT = (
    START
    + rf"""maps AS (SELECT concat('https://',site) AS site, site AS host, part, body, body LIKE '%</urlset>' AS ok FROM site_maps WHERE body LIKE '%<urlset%' AND length(site)%12 NOT IN (2,3)),
parsed AS (SELECT site, part, generate_subscripts(l,1) AS i, unnest(l) AS item FROM (SELECT site, part, regexp_extract_all(body,'<url>.*?</url>') AS l FROM maps WHERE ok)),
found AS (SELECT site, part, body, generate_subscripts(l,1) AS i, unnest(l) AS url FROM (SELECT site, part, body, list_filter({_recover('body')},lambda x, i: list_position({_recover('body')},x)=i) AS l FROM maps)),
cand AS (SELECT site, part, 0 AS recovered, i, {_norm("replace(regexp_extract(item,'<loc>(.*?)</loc>',1),'&amp;','&')")} AS url, nullif(regexp_extract(item,'<lastmod>(.*?)</lastmod>',1),'') AS lastmod FROM parsed
 UNION ALL SELECT site, part, 1, i, url, CASE WHEN instr(body,url)>0 THEN nullif(regexp_extract(substr(body,greatest(instr(body,url)-1-600,0)+1,instr(body,url)-1+1200-greatest(instr(body,url)-1-600,0)),'(?i)<lastmod[^>]*>\s*([^<\s]+)\s*</lastmod>',1),'') END FROM found),
mapped AS (SELECT site, url, lastmod FROM cand QUALIFY row_number() OVER (PARTITION BY site,url ORDER BY part,recovered,i)=1),
{RESOLVED},
robots_txt AS (SELECT DISTINCT concat('https://',site) AS site, concat('User-agent: *',chr(10),'Disallow: /en/9',chr(10),'Allow: /en/9*.html$',chr(10),'Disallow: /*?utm_source=') AS body FROM once),
entries AS (SELECT m.site, m.url, m.lastmod, CASE WHEN broken THEN NULL ELSE r.status END AS status, CASE WHEN NOT broken THEN cur END AS final_url, CASE WHEN coalesce(broken,true) THEN 0 ELSE n END AS n_hops, coalesce(loop,false) AS loop, CASE WHEN NOT broken THEN html END AS html
  FROM mapped m LEFT JOIN resolved r ON r.start_url=m.url),
""".replace("robots_txt AS", "own_robots AS")
    + PAGES.replace("FROM robots_txt)", "FROM own_robots)").replace(
        "sissues AS (SELECT site,'warning' AS severity",
        """every AS (SELECT DISTINCT concat('https://',site) AS site, site AS host, length(site)%12 AS m FROM once),
files AS (SELECT site, concat(site,'/sitemap.xml') AS sitemap_url, 0 AS depth, 0 AS pos, m<>9 AS loaded FROM every
  UNION ALL SELECT e.site, concat(e.site,'/sitemap-',p,'.xml'), 1, q, EXISTS (SELECT 1 FROM site_maps s WHERE s.sitemap_url=concat(e.site,'/sitemap-',p,'.xml')) FROM every e, (VALUES ('0',1),('1',2),('2',3),('gone',4)) t(p,q) WHERE m=10),
sissues AS (SELECT site,'notice' AS severity,'ROBOTS_NO_SITEMAP_REFERENCE' AS code,'robots.txt did not expose a Sitemap: entry; tried /sitemap.xml fallback.' AS message FROM every WHERE m=7
  UNION ALL SELECT site,'error','SITEMAPS_FOUND_BUT_UNUSABLE','Sitemap files loaded, but no usable same-host URL entries were extracted.' FROM every WHERE m IN (2,3)
  UNION ALL SELECT site,'error','NO_ACCESSIBLE_SITEMAP','No accessible XML sitemap could be loaded.' FROM every WHERE m=9
  UNION ALL SELECT site,'error','SITEMAP_FETCH_FAILED',concat('Could not load sitemap: ',sitemap_url) FROM files WHERE NOT loaded
  UNION ALL SELECT site,'warning' AS severity""",
    ).replace("Checked first 20 pages", "Checked first 500 pages").replace("n_entries>20", "n_entries>500")
)

SUMMARY = f"""own AS (SELECT site,count(*) FILTER (WHERE severity='error') AS site_errors FROM sissues GROUP BY site),
board AS (SELECT e.site, e.host, e.m, coalesce(a.n,0) AS n, coalesce(sections,0) AS sections, coalesce(errors,0) AS errors, coalesce(warnings,0) AS warnings, coalesce(notices,0) AS notices,
  coalesce(w_all,100) AS w_all, coalesce(w_t,0) AS w_t, coalesce(w_d,0) AS w_d, coalesce(w_l,0) AS w_l, coalesce(site_errors,0) AS site_errors, coalesce(f.n_entries,0) AS n_entries
  FROM every e LEFT JOIN agg a USING (site) LEFT JOIN sev USING (site) LEFT JOIN own USING (site) LEFT JOIN facts f USING (site)),
summary AS (SELECT site, n AS pages, sections, errors, warnings, notices, {{index}} AS index, {{seo}} AS seo, {{sitemap}} AS sitemap, host, n_entries FROM board)
"""

#: The stock's files in breadth-first order; those that the bounds of 9 files and 120 URLs leave, with the room before each.
BUDGET = f"""WITH {oracle_ctes()},
bfs(place, name, part, depth) AS (VALUES (0,'',NULL,0),(1,'-4',4,1),(2,'-0',0,1),(3,'-deep',NULL,1),(4,'-2',2,1),(5,'-1',1,1),(6,'-9',9,2),(7,'-5',5,2),(8,'-7',7,2)),
placed AS (SELECT concat('https://',l.site) AS site, l.url, l.lastmod, l.k, b.place FROM stock_listed l JOIN bfs b USING (part)),
won AS (SELECT * FROM placed QUALIFY row_number() OVER (PARTITION BY site, url ORDER BY place) = 1),
fresh AS (SELECT s.site, b.place, b.depth, concat(s.site,'/sitemap',b.name,'.xml') AS sitemap_url, count(w.url) AS fresh
  FROM (SELECT DISTINCT site FROM placed) s CROSS JOIN bfs b LEFT JOIN won w ON w.site = s.site AND w.place = b.place GROUP BY ALL),
visited AS (SELECT *, (120 - before)::BIGINT AS room FROM (SELECT *, coalesce(sum(fresh) OVER (PARTITION BY site ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM fresh) WHERE before < 120)"""


MIXED = f"""WITH {oracle_ctes()},
mixed AS (SELECT DISTINCT site, k, regexp_replace(url, '/(archive|tag|docs)/', CASE k % 4 WHEN 0 THEN '/Archive/' WHEN 1 THEN '/archive/' WHEN 2 THEN concat('/', chr(201), 't', chr(233), '/') ELSE '/_x-' END) AS url
  FROM (SELECT site, url, regexp_extract(url, '([0-9]+)$', 1)::BIGINT AS k FROM inventory))"""


def _with(more: str, select: str) -> str:
    return f"{BASE}{', ' + more if more else ''}\n{select}"


def _audited(select: str, more: str = "") -> str:
    return f"{AUDIT}{', ' + more if more else ''}\n{select}"


SUMMARY = SUMMARY.format(
    index=_clamp(f"100-({PENALTY})-{_round('w_t/w_all*20')}-2*greatest(0,10-sections)"),
    seo=_clamp(f"100.0::DOUBLE-errors*10.0::DOUBLE-warnings*1.25::DOUBLE-notices*0.15::DOUBLE-{_round('w_d/w_all*12')}"),
    sitemap=_clamp(f"100-({PENALTY})-{_round('w_l/w_all*10')}-15*site_errors"),
)

VERDICT = """CASE WHEN n=0 AND loaded>0 THEN 'Sitemap references were found, but no usable URL entries could be extracted.'
 WHEN n=0 THEN 'Not compatible yet: no accessible XML sitemap URLs were found.' WHEN n=1 THEN 'Single-page sitemap detected: metadata is available, but the sitemap only exposes one URL.'
 WHEN n<5 THEN concat('Thin sitemap detected: only ',n,' URLs were indexed.')
 WHEN errs>greatest(10.0,n*0.5) THEN 'Partially compatible: sitemap URLs were indexed, but many sampled pages could not be fetched.'
 WHEN failed>0 THEN 'Mostly compatible: some sitemap files failed, but usable URLs were indexed.' ELSE 'Compatible: sitemap URLs were indexed and sampled page metadata was accessible.' END"""
TOLD = """CASE WHEN n=0 THEN concat(host,' did not expose usable sitemap URLs to this run.')
 WHEN n=1 THEN concat(host,' exposed only one sitemap URL. The page may be healthy, but the sitemap inventory is thin unless this is intentionally a one-page site.')
 WHEN n<5 THEN concat(host,' exposed ',n,' sitemap URLs. This shallow inventory should be compared against the real public pages.')
 ELSE concat(host,' exposed ',format('{:,}',n),' sitemap URLs. This preview sampled ',format('{:,}',deep),' pages for metadata and kept the rest as index-only rows.') END"""


def inventory_sql(columns: str, tail: str = "") -> str:
    return f"WITH {oracle_ctes()} SELECT {columns} FROM inventory {tail}"


PREVIEW_URLS = f"SELECT DISTINCT url, {_type('url', True)} AS page_type, {_section('url', True)} AS section FROM crawl"

ORACLE_SQL: dict[str, str] = {
    "b_url_enrich": _with("", f"SELECT page_id, {_norm('url')} AS norm_url, {_norm('url')} AS dedupe_key, {_host('url')} AS host, {_path('url')} AS path, concat({_path('url')},{_search('url')}) AS display_path, concat({_path('url')},{_search('url')}) AS request_path, {_type('url')} AS page_type, {_section('url')} AS section FROM pages"),
    "b_inventory_types": inventory_sql(f"site, {_type('url')} AS page_type, {_section('url')} AS section, count(*) AS n", "GROUP BY 1,2,3"),
    "b_preview_types": _with("", f"SELECT page_id, {_type('url', True)} AS page_type, {_section('url', True)} AS section FROM pages"),
    "b_sorted_urls": _with("", f"SELECT DISTINCT {_norm('url')} AS url FROM pages"),
    "b_url_predicates": _with("", f"SELECT page_id, NOT regexp_matches(lower({_path('url')}),'/(llms|robots)\\.txt$') AND regexp_matches(lower({_path('url')}),'sitemap|\\.xml(\\.gz)?$') AS is_sitemap, NOT regexp_matches(lower({_path('url')}),'(\\.xml|\\.xml\\.gz|/llms\\.txt|/robots\\.txt)$') AS is_page FROM (SELECT page_id, CASE page_id % 5 WHEN 0 THEN url WHEN 1 THEN concat('https://e.com/a/Sitemap-',page_id) WHEN 2 THEN concat('https://e.com/',page_id,'.XML.gz?x=1') WHEN 3 THEN 'https://e.com/llms.txt' ELSE 'https://e.com/robots.txt#f' END AS url FROM pages)"),
    "b_host_variants": _with("", f"SELECT DISTINCT site, unnest([concat('https://',site), CASE WHEN site LIKE 'www.%' THEN concat('https://',substr(site,5)) ELSE concat('https://www.',site) END]) AS variant FROM crawl"),
    "b_same_host": _with("", f"SELECT site, url, coalesce({_host('canon')}={_host('url')},false) AS same_host, canon AS resolved FROM meta"),
    "b_input_mode": _with("", f"SELECT page_id, CASE WHEN page_id%3=0 THEN 'sitemap' ELSE 'site' END AS input_mode, CASE WHEN page_id%3=0 THEN concat('https://',{_host('url')},'/map.xml') ELSE concat('https://',{_host('url')}) END AS site FROM pages"),
    "c_robots_rules": _with("", "SELECT site,ua,rule_pos,allow,pattern,len FROM rrules"),
    "c_robots_groups": _with("", "SELECT DISTINCT site,ua FROM ragents"),
    "c_sitemap_directives": _with("", r"SELECT site,trim(regexp_replace(trim(raw),'(?i)^sitemap\s*:','')) AS sitemap_url,NOT raw LIKE '%llms.txt' AS usable FROM rlines WHERE regexp_matches(trim(raw),'(?i)^sitemap\s*:')"),
    "c_parsed_sitemaps": _with("", "SELECT site,value AS sitemap_url FROM rfields WHERE field='sitemap' AND value<>''"),
    "c_ignored_directives": _with("", "SELECT site,concat('Ignored non-XML Sitemap directive: ',value) AS message FROM rfields WHERE field='sitemap' AND value LIKE '%llms.txt'"),
    "c_robots_verdict": _with("", "SELECT * FROM verdict"),
    "c_conflicts": _with("", "SELECT * FROM conflict"),
    "c_conflict_counts": _with("", "SELECT * FROM blocked"),
    "d_seeds": _with("", "SELECT DISTINCT site,concat('https://',site,'/sitemap.xml') AS sitemap_url,true AS from_robots FROM crawl"),
    "d_loc_recovery": _with(ENTRIES, "SELECT site,url FROM found"),
    "d_nearby_lastmod": _with(ENTRIES, "SELECT site,url,lastmod FROM cand WHERE recovered=1"),
    "c_many_rules": f"""WITH {oracle_ctes()}, u AS (SELECT DISTINCT site, url, regexp_extract(url, '^https?://[^/]+(.*)$', 1) AS p FROM inventory),
r AS (SELECT site, path, k, length(line) - CASE WHEN line LIKE 'Allow%' THEN 7 ELSE 10 END AS len FROM stock_rules),
m AS (SELECT u.site, u.url, max(CASE WHEN k % 6 = 0 THEN CASE WHEN p = path THEN len * 2 + 1 END WHEN k % 12 = 3 THEN CASE WHEN contains(substr(p, length(path) + 1), '9') THEN len * 2 END ELSE len * 2 END) AS best
  FROM u JOIN r ON r.site = u.site AND starts_with(u.p, r.path) GROUP BY ALL)
SELECT u.site, u.url, coalesce(greatest(best, CASE WHEN p LIKE '%5' THEN 8 END, CASE WHEN starts_with(p, '/archive/1') THEN 20 END) % 2 = 1, true) AS allowed FROM u LEFT JOIN m USING (site, url)""",
    "d_page_cap_collated": f"{MIXED} SELECT site, url FROM mixed QUALIFY row_number() OVER (PARTITION BY site ORDER BY url COLLATE en, url) <= 20",
    "g_collated_ties": f"{MIXED} SELECT site, url, canonical FROM (SELECT *, concat('https://', site, '/', k % 17) AS canonical FROM mixed) QUALIFY row_number() OVER (PARTITION BY canonical ORDER BY url COLLATE en, url) = 1",
    "f_head_metadata": f"""WITH {oracle_ctes()} SELECT page_id, concat('Page ', page_id, ' ', chr(233), chr(8211), chr(128512), ' <b> &amp; ', chr(169), ' 1 &nosuch; ', chr(8211), CASE WHEN page_id % 3 = 0 THEN ' <!-- kept -->' ELSE '' END) AS title,
  CASE WHEN page_id % 5 = 0 THEN 'word' ELSE concat('It', chr(8217), 's > ', page_id) END AS description, concat('/a?x=1&y=', page_id) AS canonical, page_id % 6 = 0 AS noindex FROM crawl""",
    "r_head_extras": """SELECT page_id, CASE WHEN page_id % 7 = 0 THEN 0 WHEN page_id % 5 = 0 THEN 2 ELSE 3 END::INT AS n_alternates, CASE WHEN page_id % 2 = 0 THEN 'og:title,og:url' ELSE '' END AS open_graph,
  CASE page_id % 4 WHEN 0 THEN 'Article' WHEN 1 THEN 'Article,Person,Thing' WHEN 2 THEN 'WebPage' ELSE '' END AS schema_types FROM pages""",
    "r_alternate_problems": """WITH story AS (SELECT page_id AS p, page_id // 3 AS s, (page_id % 3)::INT AS v FROM pages),
  links AS (SELECT p, s, v, unnest(CASE WHEN p % 7 = 0 THEN [] WHEN p % 5 = 0 THEN [0, 1] ELSE [0, 1, 2] END) AS w FROM story),
  told AS (SELECT l.*, EXISTS (SELECT 1 FROM story t WHERE t.s = l.s AND t.v = l.w) AS known, EXISTS (SELECT 1 FROM links b WHERE b.s = l.s AND b.v = l.w AND b.w = l.v) AS returned FROM links l)
  SELECT DISTINCT concat('https://stories.example/', s, '/', ['en', 'fr', 'pt-br'][v + 1]) AS url, CASE WHEN w = 1 AND p % 11 = 0 THEN 'french' ELSE ['en', 'fr', 'pt-br'][w + 1] END AS lang,
  concat('https://stories.example/', s, '/', ['en', 'fr', 'pt-br'][w + 1]) AS target, CASE WHEN w = 1 AND p % 11 = 0 THEN 'bad code' WHEN NOT known THEN 'not audited' ELSE 'no return' END AS problem
  FROM told WHERE (w = 1 AND p % 11 = 0) OR (w <> v AND (NOT known OR NOT returned))""",
    "d_preview_files": f"{BUDGET} SELECT site, sitemap_url, depth, true AS loaded, room FROM visited",
    "d_preview_entries": f"{BUDGET} SELECT site, url, lastmod FROM (SELECT w.*, v.room, row_number() OVER (PARTITION BY w.site, w.place ORDER BY k DESC, url) AS n FROM won w JOIN visited v ON v.site = w.site AND v.place = w.place) WHERE n <= room",
    "d_entries_first_wins": _with(ENTRIES, "SELECT * FROM mapped"),
    "d_page_cap": _with("", "SELECT site,url FROM meta QUALIFY row_number() OVER (PARTITION BY site ORDER BY url)<=5"),
    "d_inventory_cap": inventory_sql("site,min(url) AS first_url,count(*) AS n", "WHERE url IN (SELECT url FROM (SELECT DISTINCT site AS s,url FROM inventory) QUALIFY row_number() OVER (PARTITION BY s ORDER BY url)<=50) GROUP BY site"),
    "d_candidate_choice": _with("", "SELECT site,cand_pos FROM (SELECT site,unnest([0,1,2]) AS cand_pos,n_entries FROM facts) QUALIFY row_number() OVER (PARTITION BY site ORDER BY ((n_entries+cand_pos)%3>0)::INT DESC,(n_entries%2=cand_pos%2)::INT DESC,cand_pos)=1"),
    "e_redirect_chain": _with(WALK, "SELECT e.start_url,CASE WHEN e.loop THEN h.status ELSE f.status END AS status,CASE WHEN e.loop OR f.status IS NOT NULL THEN e.cur END AS final_url,CASE WHEN e.loop OR f.status IS NOT NULL THEN e.n ELSE 0 END AS n_hops,e.loop FROM ends e LEFT JOIN (SELECT url,max(status) AS status FROM fetch_log GROUP BY url) f ON f.url=e.cur LEFT JOIN hops h ON h.url=e.visited[len(e.visited)]"),
    "f_metadata": _with("", "SELECT site,url,title,description,canonical,noindex FROM meta"),
    "f_page_checks": _with("", "SELECT site,url,ord,severity,code,message FROM (SELECT * EXCLUDE (ord), row_number() OVER (PARTITION BY site,url ORDER BY ord)::INT AS ord FROM checks)"),
    "f_check_counts": _with("", "SELECT code,severity,count(*) AS n FROM checks GROUP BY 1,2"),
    "f_page_ok": _with("", "SELECT site,url,NOT EXISTS (SELECT 1 FROM checks c WHERE c.site=meta.site AND c.url=meta.url AND c.severity='error') AS ok FROM meta"),
    "g_best_of_dedupe": _with("", "SELECT site,url,title,status FROM kept"),
    "g_dropped_counts": _with("", "SELECT * FROM dropped"),
    "g_duplicate_titles": _with("", "SELECT * FROM dup_t"),
    "g_duplicate_descriptions": _with("", "SELECT * FROM dup_d"),
    "g_merged_issues": _with("", "SELECT site,url,stage,code,severity FROM pissues"),
    "h_site_issues": _with("", "SELECT * FROM sissues"),
    "i_stats": _with("", "SELECT site,n AS pages,sections,errors,warnings,notices FROM agg JOIN sev USING (site)"),
    "i_page_weight": _with("", "SELECT page_type,w,count(*) AS n FROM w GROUP BY 1,2"),
    "i_scores_full": _with("", f"SELECT a.site,{_clamp(f'100-({PENALTY})-{_round("w_t/w_all*20")}-2*greatest(0,10-sections)')} AS index,{_clamp(f'100.0::DOUBLE-errors*10.0::DOUBLE-warnings*1.25::DOUBLE-notices*0.15::DOUBLE-{_round("w_d/w_all*12")}')} AS seo,{_clamp(f'100-({PENALTY})-{_round("w_l/w_all*10")}')} AS sitemap FROM agg a JOIN sev USING (site)"),
    "f_deep_sample": _with("", "SELECT site,url,row_number() OVER (PARTITION BY site ORDER BY url)<=3 AS deep_checked FROM meta"),
    "i_scores_preview": _with(
        """pg AS (SELECT *,row_number() OVER (PARTITION BY site ORDER BY url)<=3 AS deep FROM meta),
pv AS (SELECT site,severity FROM checks SEMI JOIN (SELECT site,url FROM pg WHERE deep) USING (site,url) UNION ALL SELECT site,severity FROM sissues),
ps AS (SELECT site,count(*) FILTER (WHERE severity='error') AS errors,count(*) FILTER (WHERE severity='warning') AS warnings,count(*) FILTER (WHERE severity='notice') AS notices FROM pv GROUP BY site),
pa AS (SELECT site,count(*) AS n,count(*) FILTER (WHERE deep)::DOUBLE AS nd,count(*) FILTER (WHERE deep AND title IS NULL)::DOUBLE AS t,count(*) FILTER (WHERE deep AND description IS NULL)::DOUBLE AS d,count(*) FILTER (WHERE lastmod IS NULL)::DOUBLE AS l FROM pg GROUP BY site)""",
        f"SELECT pa.site,{_clamp(f'100-({PENALTY})-{_round("t/greatest(nd,1)*20")}')} AS index,{_clamp(f'100.0::DOUBLE-coalesce(errors,0)*10.0::DOUBLE-coalesce(warnings,0)*1.25::DOUBLE-coalesce(notices,0)*0.15::DOUBLE-{_round("d/greatest(nd,1)*12")}')} AS seo,{_clamp(f'100-({PENALTY})-{_round("l/greatest(n::DOUBLE,1)*10")}')} AS sitemap FROM pa LEFT JOIN ps USING (site)",
    ),
    "i_verdict": _with(
        "vf AS (SELECT site,n_entries AS all_n,CASE WHEN length(site)%10=3 THEN 0 ELSE n_entries END AS n,length(site)%2 AS loaded,length(site)%3 AS failed,CASE WHEN length(site)%4=0 THEN n_entries*2 ELSE 0 END AS errs FROM facts)",
        """SELECT site,CASE WHEN n=0 AND loaded>0 THEN 'Sitemap references were found, but no usable URL entries could be extracted.'
 WHEN n=0 THEN 'Not compatible yet: no accessible XML sitemap URLs were found.' WHEN n=1 THEN 'Single-page sitemap detected: metadata is available, but the sitemap only exposes one URL.'
 WHEN n<5 THEN concat('Thin sitemap detected: only ',n,' URLs were indexed.')
 WHEN errs>greatest(10.0,n*0.5) THEN 'Partially compatible: sitemap URLs were indexed, but many sampled pages could not be fetched.'
 WHEN failed>0 THEN 'Mostly compatible: some sitemap files failed, but usable URLs were indexed.' ELSE 'Compatible: sitemap URLs were indexed and sampled page metadata was accessible.' END AS verdict,
 CASE WHEN n=0 THEN concat(site,' did not expose usable sitemap URLs to this run.')
 WHEN n=1 THEN concat(site,' exposed only one sitemap URL. The page may be healthy, but the sitemap inventory is thin unless this is intentionally a one-page site.')
 WHEN n<5 THEN concat(site,' exposed ',n,' sitemap URLs. This shallow inventory should be compared against the real public pages.')
 ELSE concat(site,' exposed ',format('{:,}',n),' sitemap URLs. This preview sampled ',format('{:,}',least(all_n,40)),' pages for metadata and kept the rest as index-only rows.') END AS summary FROM vf""",
    ),
    "i_score_tones": _with("", f"SELECT a.site,CASE WHEN s>=85 THEN 'good' WHEN s>=65 THEN 'warn' ELSE 'bad' END AS tone FROM (SELECT site,{_clamp(f'100-({PENALTY})-{_round("w_l/w_all*10")}')} AS s FROM agg) a"),
    "i_inventory_sections": inventory_sql(f"site,count(*) AS pages,count(DISTINCT {_section('url')}) AS sections", "GROUP BY site"),
    "j_search": _with("", "SELECT site,url FROM kept WHERE contains(lower(concat_ws(' ',title,url,path,display_path,section,page_type,description)),'page=2')"),
    "j_filters": _with("", "SELECT site,url FROM kept WHERE section='en' AND page_type='generated'"),
    "j_issue_filter": _with("", "SELECT DISTINCT site,url FROM pissues WHERE severity='error'"),
    "j_clean_pages": _with("", "SELECT site,url FROM kept k WHERE NOT EXISTS (SELECT 1 FROM pissues p WHERE p.site=k.site AND p.url=k.url)"),
    "j_section_facet": _with("", "SELECT DISTINCT site,section FROM kept"),
    "j_type_facet": _with("", f"SELECT DISTINCT site,page_type,{_human('page_type')} AS label FROM kept"),
    "j_recent": _with("", "SELECT site,rank,url,lastmod FROM (SELECT *,row_number() OVER (PARTITION BY site ORDER BY lastmod DESC,url)::INT AS rank FROM (SELECT * FROM kept WHERE lastmod IS NOT NULL QUALIFY row_number() OVER (PARTITION BY site,coalesce(canonical,url) ORDER BY lastmod DESC,url)=1)) WHERE rank<=8"),
    "j_top_sections": _with("", "SELECT site,rank,section,n FROM (SELECT *,row_number() OVER (PARTITION BY site ORDER BY n DESC,u)::INT AS rank FROM (SELECT site,section,count(*) AS n,min(url) AS u FROM kept GROUP BY 1,2)) WHERE rank<=10"),
    "j_issue_codes": _with("", "SELECT code,count(*) AS n FROM allissues GROUP BY code ORDER BY n DESC,code LIMIT 25"),
    "j_issue_badges": _with("", f"SELECT k.site,k.url,CASE WHEN l IS NULL THEN 'clean' WHEN len(l)>4 THEN concat(array_to_string(l[1:4],'|'),'|+',len(l)-4) ELSE array_to_string(l,'|') END AS badges FROM kept k LEFT JOIN (SELECT site,url,list({_human('code')} ORDER BY stage,ord) AS l FROM pissues GROUP BY 1,2) i USING (site,url)"),
    "j_findings": _with("", f"SELECT k.site,k.url,coalesce(title,path) AS label,coalesce(len(l),0)::INT AS n_issues,coalesce(array_to_string(l[1:5],', '),'Clean') AS findings FROM kept k LEFT JOIN (SELECT site,url,list({_human('code')} ORDER BY stage,ord) AS l FROM pissues GROUP BY 1,2) i USING (site,url)"),
    "j_inventory_page": _with("", "SELECT site,url,rank FROM (SELECT site,url,row_number() OVER (PARTITION BY site ORDER BY url)::INT AS rank FROM kept) WHERE rank<=3"),
    "j_hidden_counts": _with("", "SELECT site,greatest(0,count(*)-3) AS hidden FROM kept GROUP BY site"),
    "j_visible_count": _with("", "SELECT count(*) AS n FROM kept WHERE section='en'"),
    "j_priority_list": _with("", "SELECT site,url,count(*) FILTER (WHERE severity='error') AS n_errors,count(*) FILTER (WHERE severity='warning') AS n_warnings,count(*) FILTER (WHERE severity='notice') AS n_notices FROM pissues GROUP BY 1,2"),
    "j_type_breakdown": _with("", "SELECT site,page_type,count(*) AS n FROM kept GROUP BY 1,2"),
    "a_csv_rows": _with("", "SELECT k.url,coalesce(title,'') AS title,coalesce(lastmod,'') AS lastmod,coalesce(status::VARCHAR,'') AS status,'0' AS redirects,coalesce(i.n,0)::VARCHAR AS issue_count,coalesce(l,'') AS issues FROM kept k LEFT JOIN (SELECT site,url,count(*) AS n,string_agg(concat(severity,':',code),'|' ORDER BY stage,ord) AS l FROM pissues GROUP BY 1,2) i USING (site,url)"),
    "a_run_counters": "SELECT count(*) AS runs, sum(CAST(user_id % 500 AS BIGINT))::BIGINT AS pages FROM events",
    "r_compare_crawls": _with("", "SELECT coalesce(a.site,b.site) AS site,coalesce(a.url,b.url) AS url,CASE WHEN a.url IS NULL THEN 'added' WHEN b.url IS NULL THEN 'removed' WHEN a.title IS NOT DISTINCT FROM b.title AND a.description IS NOT DISTINCT FROM b.description AND a.canonical IS NOT DISTINCT FROM b.canonical AND a.status IS NOT DISTINCT FROM b.status AND a.lastmod IS NOT DISTINCT FROM b.lastmod THEN 'same' ELSE 'changed' END AS change FROM (SELECT * FROM meta WHERE length(url)%5<>0) a FULL JOIN (SELECT site,url,title,description,canonical,status,CASE WHEN length(url)%7=1 THEN '2025-01-01' ELSE lastmod END AS lastmod FROM meta WHERE length(url)%5<>3) b USING (site,url)"),
    "d_sitemap_files": _with("", "SELECT DISTINCT site,concat('https://',site,'/sitemap.xml') AS sitemap_url,0 AS depth,true AS loaded FROM crawl"),
    "d_candidate_seeds": _with("", """SELECT site,cand_pos,base,CASE WHEN cand_pos=0 THEN 0 ELSE pos END AS pos,sitemap_url,cand_pos=0 AS from_robots FROM (
 SELECT site,cand_pos,base,unnest(generate_series(0,CASE WHEN cand_pos=0 THEN 0 ELSE 4 END))::INT AS pos,concat(base,unnest(CASE WHEN cand_pos=0 THEN ['/sitemap.xml'] ELSE ['/sitemap.xml','/sitemap_index.xml','/sitemap-index.xml','/wp-sitemap.xml','/sitemap/sitemap.xml'] END)) AS sitemap_url
 FROM (SELECT concat('https://',s) AS site,unnest([0,1])::INT AS cand_pos,unnest([concat('https://',s),CASE WHEN s LIKE 'www.%' THEN concat('https://',substr(s,5)) ELSE concat('https://www.',s) END]) AS base FROM (SELECT DISTINCT site AS s FROM crawl)))"""),
    "e_hop_limit": _with(RESOLVED, "SELECT start_url,CASE WHEN NOT broken THEN status END AS status,CASE WHEN NOT broken THEN cur END AS final_url,CASE WHEN broken THEN 0 ELSE n END AS n_hops,loop,truncated FROM resolved"),
    "f_preview_checks": _with("", """SELECT site,url,'notice' AS severity,'NON_HTML_RESPONSE' AS code,'Response content-type was application/pdf.' AS message FROM meta WHERE length(url)%5=1
 UNION ALL SELECT site,url,'warning','BOT_PROTECTION_DETECTED','Page response looks like bot protection or an access challenge.' FROM entries WHERE length(url)%6=2 OR regexp_matches(substr(html,1,1200),'(?i)cloudflare|access denied|captcha|bot detection|verify you are human|akamai|perimeterx|blocked|forbidden')
 UNION ALL SELECT site,url,'notice','FETCH_DETAIL','timed out' FROM meta WHERE length(url)%7=3"""),
    "f_index_only": _with("", "SELECT site,url,'notice' AS severity,'INDEX_ONLY_NOT_FETCHED' AS code,'URL was indexed from sitemap but not deep-fetched in this preview.' AS message FROM meta QUALIFY row_number() OVER (PARTITION BY site ORDER BY url)>3"),
    "h_preview_issues": _with("hf AS (SELECT site,CASE WHEN n_entries>8 THEN n_entries*300 WHEN n_entries>5 THEN n_entries*10 WHEN n_entries=5 THEN 0 ELSE n_entries END AS n,n_entries%2 AS loaded,length(site)%2=0 AS rob,length(site)%3<>0 AS as_site FROM facts)", """SELECT site,'notice' AS severity,'ROBOTS_NO_USABLE_SITEMAP_REFERENCE' AS code,'robots.txt did not expose a usable XML Sitemap directive; common sitemap paths and host variants were tried.' AS message FROM hf WHERE NOT rob AND as_site
 UNION ALL SELECT site,'error','SITEMAPS_FOUND_BUT_UNUSABLE','Sitemap references were found, but no usable URL entries could be extracted.' FROM hf WHERE n=0 AND loaded>0
 UNION ALL SELECT site,'error','NO_ACCESSIBLE_SITEMAP','No accessible XML sitemap could be loaded.' FROM hf WHERE n=0 AND loaded=0
 UNION ALL SELECT site,'warning','SINGLE_URL_SITEMAP','Only 1 URL was found in the sitemap inventory. This is thin unless the site is intentionally one page.' FROM hf WHERE n=1
 UNION ALL SELECT site,'warning','THIN_SITEMAP',concat('Only ',n,' URLs were found in the sitemap inventory.') FROM hf WHERE n BETWEEN 2 AND 4
 UNION ALL SELECT site,'notice','URL_INDEX_LIMIT_REACHED','The preview indexed the first 1,200 URLs. Use the full profile for a complete export.' FROM hf WHERE n>=1200
 UNION ALL SELECT site,'notice','DEEP_CHECK_LIMIT_REACHED','The preview deep checked 40 pages and kept the rest as index-only rows.' FROM hf WHERE n>40
 UNION ALL SELECT site,'warning','SITEMAP_FETCH_FAILED',concat('Could not load sitemap: https://',site,'/gone.xml') FROM hf WHERE length(site)%4=1
 UNION ALL SELECT site,'notice','DISCOVERY_NOTE',concat('note on ',site) FROM hf WHERE length(site)%5=1"""),
    "audit_entries": _audited("SELECT site,url,lastmod FROM mapped"),
    "audit_files": _audited("SELECT site,sitemap_url,depth,loaded FROM files"),
    "audit_pages": _audited("SELECT site,url,final_url,status,nullif(n_hops,0) AS redirects,title,description,canonical,lastmod,page_type,section,NOT EXISTS (SELECT 1 FROM checks c WHERE c.site=kept.site AND c.url=kept.url AND c.severity='error') AS ok FROM kept"),
    "audit_page_issues": _audited("SELECT site,url,stage,severity,code,message FROM pissues"),
    "audit_site_issues": _audited("SELECT site,severity,code,message FROM sissues"),
    "audit_index_pages": _audited("""SELECT site,k.url,title,status,coalesce(i.l,'') AS issues,index,seo,sitemap,pages AS site_pages,coalesce(r.l,'') AS site_issues FROM kept k JOIN summary USING (site)
 LEFT JOIN (SELECT site,url,string_agg(concat(severity,':',code),'|' ORDER BY concat(severity,':',code)) AS l FROM pissues GROUP BY 1,2) i USING (site,url)
 LEFT JOIN (SELECT site,string_agg(concat(severity,':',code),'|' ORDER BY concat(severity,':',code)) AS l FROM sissues GROUP BY 1) r USING (site)""", SUMMARY),
    "audit_summary": _audited("SELECT site,pages,sections,errors,warnings,notices,index,seo,sitemap FROM summary", SUMMARY),
    "audit_report": _audited(
        f"SELECT site,pages,sections,errors,warnings,notices,index,seo,sitemap,{VERDICT} AS verdict,{TOLD} AS summary,concat(site,'/robots.txt') AS robots_url,sitemap_urls,m<>7 AS from_robots,n AS n_entries,'site' AS input_mode,deep AS n_deep FROM told",
        SUMMARY
        + """, bad AS (SELECT site,count(DISTINCT url) AS errs FROM pissues WHERE severity='error' GROUP BY site),
 seen AS (SELECT site,count(*) FILTER (WHERE loaded) AS loaded,count(*) FILTER (WHERE NOT loaded) AS failed,coalesce(string_agg(sitemap_url,'|' ORDER BY depth,pos) FILTER (WHERE loaded),concat(site,'/sitemap.xml')) AS sitemap_urls FROM files GROUP BY site),
 told AS (SELECT s.* EXCLUDE (n_entries),s.n_entries AS n,s.pages AS deep,e.m,loaded,failed,sitemap_urls,coalesce(errs,0) AS errs FROM summary s JOIN every e USING (site) JOIN seen USING (site) LEFT JOIN bad USING (site))""",
    ),
}
