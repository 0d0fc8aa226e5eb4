"""URL cleaning as column expressions.

A URL is taken apart into an array of parts (path segments, query pairs, fragment
pieces), every part goes through one lambda that decides what to redact, and the
parts are joined again. One lambda means one copy of the span rules per URL depth.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veil.functions import rules as R
from veil.functions import text_sql as S
from veil.functions.spans import NO_SPANS, all_spans, cut_spans, masked

MAX_URL = 2048
TOKEN = "[REDACTED_TOKEN]"
EMAIL_MARK = "[REDACTED_EMAIL]"

# ---------------------------------------------------------------------------
# Key names, token shapes and path words that mark a secret.
# ---------------------------------------------------------------------------
HTTP = "(?i)^https?://"
SECRET_KEY_SHAPE = rf"{R.BL}(?:sk_live_|ghp_|akIA|xox[baprs]-|AIza)[A-Za-z0-9_]{{16,}}{R.BR}"
SECRET_PARAM = (
    "(?i)(?:^|[_-])(?:token|secret|auth|key|password|pwd|pass|session|jwt|code|signature|sig|credential|private"
    r"|hash|apikey|api_key|access_token|id_token|refresh_token|bearer)(?:\z|[_-])"
)
PERSONAL_PARAM = (
    "(?i)(?:^|[_-])(?:email|mail|user|username|account|phone|mobile|tel|card|cvv|pan|aadhaar|ssn|dob|birth)"
    r"(?:\z|[_-])"
)
TOKEN_PATH_WORDS = (
    "token", "tokens", "reset", "password-reset", "auth", "session", "sessions", "invite", "invites", "verify",
    "verification", "key", "keys", "secret", "apikey", "otp", "code", "confirmation",
)
URL_IN_TEXT = rf"""(?i)https?://[^{R.WS_CHARS}"'<>)]+"""
BEARER = rf"(?i)(?:bearer{R.WS}+)[A-Za-z0-9_\-.]{{8,}}"
PREFIXED_KEY = (
    rf"(?i){R.BL}(?:sk_live_|ghp_|akIA|sec_|secret_|tok_|token_|api_key_|apikey_|key_)[A-Za-z0-9_]{{3,}}{R.BR}"
)
ASSIGNED_SECRET = (
    rf"(?i)({R.BL}(?:token|secret|key|apiKey|auth|session|password|jwt)[_:{R.WS_CHARS}=]+['\"]?)"
    r"([A-Za-z0-9_\-.]{8,})(['\"]?)"
)
LONG_HEX = rf"{R.BL}[0-9a-fA-F]{{24,}}{R.BR}"
# ---------------------------------------------------------------------------

CANARY = "(?i)" + R.canary_pattern()
EMAIL = "(?i)" + R.EMAIL

_URL = r"(?s)^([A-Za-z][A-Za-z0-9+.-]*):(?://([^/?#\\]*))?([^?#]*)(\?[^#]*)?(#.*)?\z"
_SPECIAL = r"(?i)^(?:https?|wss?|ftp|file)\z"
_HOST_OK = r"(?i)^[^\s<>^|%@\[\]\\]+\z"
_NEEDS_ESCAPE = r"[^\x21-\x7E]|[<>\x22]"


def _decode(v: str) -> str:
    """Percent-decoding that keeps ``+`` and falls back to the raw text on a bad escape."""
    return f"coalesce(try_url_decode(replace({v}, '+', '%2B')), {v})"


def _encode(v: str) -> str:
    """Percent-encode what a URL may not carry literally."""
    c = S.fresh("c")
    one = f"CASE WHEN {S.rlike(c, _NEEDS_ESCAPE)} THEN replace(url_encode({c}), '+', '%20') ELSE {c} END"
    return S.let(v, lambda t: (
        f"CASE WHEN {S.rlike(t, _NEEDS_ESCAPE)} THEN array_join(transform(split({t}, ''), {c} -> {one}), '') "
        f"ELSE {t} END"))


def _clean_part(p: str) -> str:
    """One URL part -> its outgoing text. ``p`` is a struct of owner, place, kind, prev, key, value.

    A query value that is itself a URL is not decided here: its own parts are in the
    same array and :func:`clean_url` puts it together.
    """
    value, key, kind, prev = f"{p}.value", f"{p}.key", f"{p}.kind", f"{p}.prev"
    token, email = S.text(TOKEN), S.text(EMAIL_MARK)

    def with_decoded(d: str) -> str:
        canary = f"({S.rlike(d, CANARY)} OR {S.rlike(value, CANARY)})"
        token_shape = f"({S.rlike(d, R.JWT)} OR {S.rlike(d, SECRET_KEY_SHAPE)})"
        email_like = f"({S.rlike(d, EMAIL)} OR {S.rlike(value, EMAIL)})"
        has_at = f"contains({d}, '@')"

        mail_in_pair = f"{email_like} OR ({has_at} AND contains({d}, '.'))"
        # What a part becomes where no span of it matters; NULL where its spans decide.
        segment = S.case(
            (canary, token),
            (f"{email_like} OR {has_at}", "NULL"),
            (token_shape, token),
            (f"lower({prev}) IN ({S.names(TOKEN_PATH_WORDS)}) AND {S.rlike(d, r'^[A-Za-z0-9_-]{8,}' + END)}", token),
            (S.rlike(d, rf"^[0-9a-fA-F]{{24,}}{END}|^[A-Za-z0-9_-]{{32,}}{END}"), token),
            otherwise="NULL")
        pair = S.case(
            (f"{canary} OR {S.rlike(key, SECRET_PARAM)}", token),
            (S.rlike(key, PERSONAL_PARAM), f"CASE WHEN {S.rlike(d, EMAIL)} OR {has_at} THEN {email} END"),
            (mail_in_pair, "NULL"),
            (token_shape, token),
            (S.rlike(d, rf"^[0-9a-fA-F]{{16,}}{END}|^[A-Za-z0-9+/_=-]{{24,}}{END}"), token),
            otherwise="NULL")
        anchor = S.case(
            (f"{S.rlike(d, CANARY)} OR {token_shape}", token),
            (f"{S.rlike(d, EMAIL)} OR {has_at}", email),
            otherwise="NULL")
        bare = S.case(
            (f"{S.rlike(value, SECRET_PARAM)} OR {S.rlike(value, CANARY)}", f"concat({value}, '={TOKEN}')"),
            (S.rlike(d, EMAIL), email),
            otherwise=value)
        unscanned = S.case(
            (f"{kind} = 'broken'", "NULL"),
            (f"{kind} = 'bare'", bare),
            (f"{value} = '' AND {kind} = 'pair'", f"concat({key}, '=')"),
            (f"{value} = ''", "''"),
            (f"{kind} = 'pair'", f"concat({key}, '=', {pair})"),
            (f"{kind} = 'anchor'", anchor),
            otherwise=segment)

        def with_scrub(s: str) -> str:
            masked_email = f"CASE WHEN contains({s}.masked, {email}) THEN {s}.masked ELSE {email} END"
            pii = f"CASE WHEN {s}.n > 0 THEN {s}.masked ELSE {value} END"
            scanned_pair = S.case((S.rlike(key, PERSONAL_PARAM), f"{s}.masked"), (mail_in_pair, masked_email), otherwise=pii)
            return S.case(
                (f"{kind} = 'broken'", scrub_tail(f"{s}.masked")),
                (f"{kind} = 'pair'", f"concat({key}, '=', {scanned_pair})"),
                (f"{kind} = 'segment' AND ({email_like} OR {has_at})", masked_email),
                otherwise=pii)

        spans = f"CASE WHEN {S.rlike(d, R.MAYBE_SENSITIVE)} THEN {all_spans(d)} ELSE {NO_SPANS} END"
        scrub = S.let(spans, lambda sp: f"named_struct('masked', {cut_spans(d, sp)}, 'n', size({sp}))")
        return f"coalesce({unscanned}, {S.let(scrub, with_scrub)})"

    return S.let(f"CASE WHEN {kind} = 'broken' THEN {value} ELSE {_decode(value)} END", with_decoded)


END = r"\z"
_NO_PARTS = "cast(array() as array<struct<place:string,kind:string,prev:string,key:string,value:string>>)"


def _part(place: str, kind: str, prev: str, key: str, value: str) -> str:
    return f"named_struct('place', '{place}', 'kind', '{kind}', 'prev', {prev}, 'key', {key}, 'value', {value})"


def _segments(place: str, path: str) -> str:
    s, i = S.fresh("s"), S.fresh("i")
    return S.let(f"split({path}, '/', -1)", lambda segs: (
        f"transform({segs}, ({s}, {i}) -> "
        + _part(place, "segment", f"CASE WHEN {i} > 0 THEN get({segs}, {i} - 1) ELSE '' END", "''", s) + ")"))


def _pairs(place: str, query: str) -> str:
    """Query-string pairs; empty pairs vanish, pairs without ``=`` are ``bare``."""
    q, e = S.fresh("q"), S.fresh("e")
    pair = _part(place, "pair", "''", f"substring_index({q}, '=', 1)", f"substring({q}, instr({q}, '=') + 1)")
    return (
        f"transform(filter(split({query}, '&', -1), {e} -> {e} != ''), {q} -> "
        f"CASE WHEN contains({q}, '=') THEN {pair} ELSE {_part(place, 'bare', chr(39) * 2, chr(39) * 2, q)} END)"
    )


def _fragment_parts(h: str) -> str:
    return S.case(
        (f"{h} = ''", _NO_PARTS),
        (f"contains({h}, '=')", _pairs("fragment", h)),
        (f"startswith({h}, '/')", _segments("fragment", h)),
        otherwise=f"array({_part('fragment', 'anchor', chr(39) * 2, chr(39) * 2, h)})")


def _reassemble(u: str, parts: str) -> str:
    def joined(place, sep):
        p, o = S.fresh("p"), S.fresh("o")
        return (f"array_join(transform(filter({parts}, {p} -> {p}.place = '{place}'), {o} -> {o}.out), {sep})")

    base = f"concat({u}.scheme, '://', {u}.host, {joined('path', chr(39) + '/' + chr(39))})"
    query = S.let(joined("query", "'&'"), lambda t: f"CASE WHEN {t} != '' THEN concat('?', {t}) ELSE '' END")
    fragment = S.let(
        f"CASE WHEN contains({u}.hash, '=') THEN {joined('fragment', chr(39) + '&' + chr(39))} "
        f"ELSE {joined('fragment', chr(39) + '/' + chr(39))} END",
        lambda t: f"CASE WHEN {t} != '' THEN concat('#', {t}) ELSE '' END")
    # Over the cap the fragment goes first, then the query is cut.
    return S.let(f"named_struct('base', {base}, 'query', {query}, 'frag', {fragment})", lambda r: (
        f"CASE WHEN length({r}.base) + length({r}.query) + length({r}.frag) <= {MAX_URL} "
        f"THEN concat({r}.base, {r}.query, {r}.frag) ELSE left(concat({r}.base, {r}.query), {MAX_URL}) END"))


def _parsed(t: str) -> str:
    def piece(i):
        return f"regexp_extract({t}, {S.lit(_URL)}, {i})"

    def with_scheme(x):
        host = S.case(
            (f"{x}.scheme IN ('http', 'ws')", f"regexp_replace({x}.authority, r':(?:80)?\\z', '')"),
            (f"{x}.scheme IN ('https', 'wss')", f"regexp_replace({x}.authority, r':(?:443)?\\z', '')"),
            otherwise=f"{x}.authority")
        special = S.rlike(f"{x}.scheme", _SPECIAL)
        path = f"CASE WHEN {special} AND {piece(3)} = '' THEN '/' ELSE {piece(3)} END"
        return S.let(host, lambda h: (
            f"named_struct('scheme', {x}.scheme, 'host', {h}, 'path', {_encode(path)}, "
            f"'search', {_encode(f'substring({piece(4)}, 2)')}, 'hash', {_encode(f'substring({piece(5)}, 2)')}, "
            f"'ok', {S.rlike(t, _URL)} AND (NOT {special} OR {x}.scheme = 'file' OR {S.rlike(h, _HOST_OK)}))"))

    raw = f"named_struct('scheme', lower({piece(1)}), 'authority', lower(regexp_replace({piece(2)}, '^.*@', '')))"
    return S.let(raw, with_scheme)


def _all_parts(u: str) -> str:
    return (f"concat({_segments('path', u + '.path')}, {_pairs('query', u + '.search')}, "
            f"{_fragment_parts(u + '.hash')})")


def _owned(parts: str, owner: str) -> str:
    p = S.fresh("p")
    return (f"transform({parts}, {p} -> named_struct('owner', {owner}, 'place', {p}.place, 'kind', {p}.kind, "
            f"'prev', {p}.prev, 'key', {p}.key, 'value', {p}.value))")


def _is_nested(p: str) -> str:
    return f"({p}.kind = 'pair' AND {S.rlike(_decode(p + '.value'), HTTP)})"


def _parts_of(u: str, raw: str) -> str:
    """Parts of a URL; what cannot be parsed is one ``broken`` part."""
    return f"CASE WHEN {u}.ok THEN {_all_parts(u)} ELSE array({_part('whole', 'broken', chr(39) * 2, chr(39) * 2, raw)}) END"


def _joined_url(url: str, number: str, parts: str, outs: str) -> str:
    """URL ``number`` put together from the cleaned parts it owns."""
    p, o, z = S.fresh("p"), S.fresh("o"), S.fresh("z")
    own = (f"filter(zip_with({parts}, {outs}, ({p}, {o}) -> named_struct('owner', {p}.owner, 'place', {p}.place, 'out', {o})), "
           f"{z} -> {z}.owner = {number})")
    return S.let(own, lambda mine: f"CASE WHEN {url}.u.ok THEN {_reassemble(url + '.u', mine)} ELSE left(get({mine}, 0).out, {MAX_URL}) END")


def _nested_urls(t: str, first: str) -> str:
    """All URLs inside URL ``t`` and all their parts: ``struct<urls, parts, since>``, level by level.

    A URL in a query value needs an equals sign, plain or encoded however often, so their number bounds the levels; a
    level without a URL adds nothing.
    """
    p, i, j, k, m, step = (S.fresh(n) for n in ("p", "i", "j", "k", "m", "step"))

    def grown(acc):
        found = f"filter(transform({acc}.parts, ({p}, {i}) -> CASE WHEN {i} >= {acc}.since AND {_is_nested(p)} THEN {i} END), {j} -> {j} IS NOT NULL)"

        def with_found(at):
            raw = _decode(f"get({acc}.parts, {k}).value")
            urls = S.let(raw, lambda r: f"named_struct('parent', {k}, 'raw', {r}, 'u', {_parsed(r)})")
            return S.let(f"transform({at}, {k} -> {urls})", lambda more: (
                f"named_struct('urls', concat({acc}.urls, {more}), 'parts', concat({acc}.parts, flatten(transform({more}, ({m}, {i}) -> "
                + _owned(_parts_of(f"{m}.u", f"{m}.raw"), f"size({acc}.urls) + {i}") + f"))), 'since', size({acc}.parts))"))

        return S.let(found, with_found)

    start = S.let(_owned(_parts_of(first, t), "0"), lambda parts: (
        f"named_struct('urls', array(named_struct('parent', -1, 'raw', {t}, 'u', {first})), 'parts', {parts}, 'since', 0)"))
    acc = S.fresh("acc")
    levels = f"size(regexp_extract_all({t}, '=|3[dD]', 0))"
    steps = f"CASE WHEN {levels} > 0 AND rlike(substring({t}, 2), '(?i)http|%') THEN sequence(1, {levels}) ELSE cast(array() as array<int>) END"
    return f"aggregate({steps}, {start}, ({acc}, {step}) -> CASE WHEN {acc}.since = size({acc}.parts) THEN {acc} ELSE {grown(acc)} END)"


def clean_url(value: str) -> str:
    """Outgoing form of a URL; NULL and blank become ''. URLs in query values are cleaned the same way, however deep."""
    def body(t):
        def with_state(st):
            c = S.fresh("c")
            outs = f"transform({st}.parts, {c} -> CASE WHEN {_is_nested(c)} THEN '' ELSE {_clean_part(c)} END)"
            return S.let(outs, lambda o: inwards(st, o))

        def inwards(st, outs):
            # The innermost URLs come last; each is written into the part of its parent before the parent is joined.
            o, k, x, i = (S.fresh(n) for n in ("o", "k", "x", "i"))
            inner = _joined_url(f"get({st}.urls, {k})", k, f"{st}.parts", o)
            numbers = f"CASE WHEN size({st}.urls) > 1 THEN reverse(sequence(1, size({st}.urls) - 1)) ELSE cast(array() as array<int>) END"
            done = (f"aggregate({numbers}, {outs}, ({o}, {k}) -> transform({o}, ({x}, {i}) -> CASE WHEN {i} = get({st}.urls, {k}).parent "
                    f"THEN concat(get({st}.parts, {i}).key, '=', {inner}) ELSE {x} END))")
            return S.let(done, lambda d: _joined_url(f"get({st}.urls, 0)", "0", f"{st}.parts", d))

        internal = f"{t} = 'about:blank' OR startswith({t}, 'chrome://newtab')"
        whole = S.let(_parsed(t), lambda u: S.let(_nested_urls(t, u), with_state))
        return S.case((f"{t} = ''", "''"), (internal, t), otherwise=whole)

    return S.let(f"regexp_replace(coalesce({value}, ''), {S.lit(rf'^{R.WS}+|{R.WS}+' + END)}, '')", body)


def clean_urls_in_text(value: str) -> str:
    """URLs embedded in running text go through :func:`clean_url`; the rest is untouched."""
    return f"CASE WHEN contains({value}, '://') THEN {S.replace_matches(value, URL_IN_TEXT, clean_url)} ELSE {value} END"


def scrub_tail(value: str) -> str:
    """Secrets that carry no personal data: bearer values, canaries, keys, ``token=``, long hex."""
    steps = (
        ("bearer", BEARER, "Bearer " + TOKEN),
        ("canary", CANARY, TOKEN),
        ("eyj", R.JWT, TOKEN),
        ("_", PREFIXED_KEY, TOKEN),
        ("token|secret|key|auth|session|password|jwt", ASSIGNED_SECRET, "$1" + TOKEN + "$3"),
        (None, LONG_HEX, TOKEN),
    )
    out = value
    for words, pattern, by in steps:
        if words is None:
            out = S.let(out, lambda t: (
                f"CASE WHEN {S.rlike(t, '[0-9a-fA-F]{24}')} THEN {S.replace_all(t, pattern, by)} ELSE {t} END"))
            continue
        out = S.let(out, lambda t, w=words, p=pattern, b=by: (
            "CASE WHEN " + " OR ".join(f"contains(lower({t}), '{x}')" for x in w.split("|"))
            + f" THEN {S.replace_all(t, p, b)} ELSE {t} END"))
    return out


def free_text(value: str) -> str:
    """URLs, then spans, then stand-alone secrets. NULL stays NULL."""
    cleaned = S.let(clean_urls_in_text(value), masked)
    return f"CASE WHEN {value} IS NOT NULL THEN {scrub_tail(cleaned)} END"


def clean_url_col(name: str) -> Column:
    return F.expr(clean_url(name))


def free_text_col(name: str) -> Column:
    return F.expr(free_text(name))
