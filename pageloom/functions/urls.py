"""URL functions: split, normalise, resolve, compare, name files.

Each takes SQL expressions and returns one (see :mod:`pageloom.functions.text`).
A URL that cannot be parsed gives NULL (or false for predicates).
"""

from __future__ import annotations

from pageloom.functions.text import cut_bytes, extract, keep, let, literal, matches, substitute

_MARK = "\x01"  # cannot occur in a parsable URL, so it is a safe separator
# RFC 3986, appendix B: scheme, //authority, path, ?query, #fragment
_SHAPE = r"(?s)^(?:([a-zA-Z][a-zA-Z0-9+.\-]*):)?(//[^/?#]*)?([^?#]*)(\?[^#]*)?(#.*)?$"

_BAD_ANYWHERE = r"[\x00-\x1f\x7f]|^:"
_BAD_ESCAPE = r"%(?![0-9a-fA-F]{2})"
_USER_OK = r"^[A-Za-z0-9\-._:~!$&'()*+,;=%@]*$"
_HOST_OK = (
    r"^(?:\[[^\]@/\\ ]*\](?::[0-9]*)?"
    r"|(?:[^\x00-\x20\x7f\^`{|}\\%@/?#\[\]:]|%25|%[89a-fA-F][0-9a-fA-F])*(?::[0-9]*)?)$"
)
_PATH_OK = r"^[A-Za-z0-9\-_.~$&+,/:;=@!'()*\[\]%]*$"
_DOTS = r"(?:^|/)\.\.?(?:/|$)"
_LAST_SLASH = r"(?:/|%2[fF])$"


def _scheme(part: str) -> str:
    return f"{part}[0]"


def _authority(part: str) -> str:
    return f"{part}[1]"


def _path(part: str) -> str:
    return f"{part}[2]"


def _query(part: str) -> str:
    return f"{part}[3]"


def _fragment(part: str) -> str:
    return f"{part}[4]"


def _host(authority: str) -> str:
    return substitute(authority, r"(?s)^//(?:.*@)?", "")


def _parsable(raw: str, part: str) -> str:
    user = extract(_authority(part), r"(?s)^//(.*)@", 1)
    first = extract(_path(part), r"^[^/]*")
    confusing = f"{_scheme(part)} = '' AND {_authority(part)} = '' AND contains({first}, ':')"
    bad_authority = (
        f"{_authority(part)} != '' AND (NOT {matches(_host(_authority(part)), _HOST_OK)}"
        f" OR contains({_authority(part)}, '@') AND"
        f" (NOT {matches(user, _USER_OK)} OR {matches(user, _BAD_ESCAPE)}))"
    )
    bad_escape = (
        f"contains({raw}, '%') AND"
        f" ({matches(_path(part), _BAD_ESCAPE)} OR {matches(_fragment(part), _BAD_ESCAPE)})"
    )
    return f"NOT ({matches(raw, _BAD_ANYWHERE)} OR {confusing} OR {bad_authority} OR {bad_escape})"


def _opaque(part: str) -> str:
    """``mailto:x`` and the like: a scheme without authority or rooted path."""
    return (
        f"({_scheme(part)} != '' AND {_authority(part)} = ''"
        f" AND NOT startswith({_path(part)}, '/'))"
    )


def split_url(url: str) -> str:
    """``array(scheme, //authority, path, ?query, #fragment)``, or NULL if malformed.

    Delimiters stay on authority, query and fragment so that an empty part and a
    missing part differ.  The path comes out in its escaped form.
    """
    groups = _MARK.join(f"${i}" for i in range(1, 6))
    shaped = f"split({substitute(url, _SHAPE, groups)}, {literal(_MARK)})"

    def checked(part: str) -> str:
        path = f"if({_opaque(part)}, {_path(part)}, {_tidy_path(_path(part))})"
        fields = (
            f"array(lower({_scheme(part)}), {_authority(part)}, {path},"
            f" {_query(part)}, {_fragment(part)})"
        )
        return f"CASE WHEN size({part}) = 5 AND {_parsable(url, part)} THEN {fields} END"

    return let(shaped, checked)


def _escape(text: str, keep_chars: str) -> str:
    """Percent-encode UTF-8 bytes; unreserved characters and ``keep_chars`` stay."""
    out = f"replace(replace(replace(url_encode({text}), '+', '%20'), '*', '%2A'), '%7E', '~')"
    for char in keep_chars:
        out = f"replace({out}, '%{ord(char):02X}', {literal(char)})"
    return out


def _unescape(text: str) -> str:
    return f"if(contains({text}, '%'), try_url_decode(replace({text}, '+', '%2B')), {text})"


def _escape_path(path: str) -> str:
    return _escape(path, "$&+,/:;=@")


def _tidy_path(path: str) -> str:
    """A path as it is written out: left alone when already valid, else re-encoded."""
    return f"if({matches(path, _PATH_OK)}, {path}, {_escape_path(_unescape(path))})"


def _lower_host(authority: str) -> str:
    """Lower-case the host only; user info keeps its case."""
    simple = matches(authority, r"^[!-$&-?A-~]*$")  # ASCII without % and @
    prefix = extract(authority, r"(?s)^//(?:.*@)?")
    host = let(_host(authority), lambda h: f"if({matches(h, '^[!-$&-~]*$')}, lower({h}), {_code(h)})")
    return f"if({simple}, lower({authority}), concat({prefix}, {host}))"


def _code(host: str) -> str:
    return _escape(f"lower({_unescape(host)})", "!$&'()*+,;=:[]<>\"")


def join_url(part: str) -> str:
    scheme = f"if({_scheme(part)} = '', '', concat({_scheme(part)}, ':'))"
    rest = ", ".join(field(part) for field in (_authority, _path, _query, _fragment))
    return f"concat({scheme}, {rest})"


def _cut_slash(path: str) -> str:
    """Drop one trailing slash, except on the root path."""
    # A cut path is always written from its decoded form.
    cut = let(substitute(path, _LAST_SLASH, ""), lambda rest: _escape_path(_unescape(rest)))
    return f"if({path} = '/' OR NOT {matches(path, _LAST_SLASH)}, {path}, {cut})"


def normalize_parts(part: str) -> str:
    """Normalised string of an already split URL; NULL unless http or https."""
    path = f"if({_opaque(part)}, {_path(part)}, {_cut_slash(_path(part))})"
    return (
        f"CASE WHEN {_scheme(part)} IN ('http', 'https') THEN"
        f" concat({_scheme(part)}, ':', {_lower_host(_authority(part))}, {path}, {_query(part)}) END"
    )


def normalize_url(url: str) -> str:
    """Lower-case scheme and host, drop the fragment and one trailing slash.

    Ports, query order, user info and ``www.`` are kept; anything that is not an
    absolute http(s) URL gives NULL.
    """
    return let(split_url(url), normalize_parts)


def _remove_dots(path: str) -> str:
    """RFC 3986 section 5.2.4 over the segments of an absolute path."""
    segments = f"split({substitute(path, '^/', '')}, '/')"
    folded = (
        f"aggregate({segments}, cast(array() AS array<string>), (acc, seg) ->"
        " CASE WHEN seg = '.' THEN acc"
        " WHEN seg = '..' THEN slice(acc, 1, greatest(size(acc) - 1, 0))"
        " ELSE concat(acc, array(seg)) END)"
    )
    ends_in_dots = matches(path, r"(?:^|/)\.\.?$")
    folder = f"if({ends_in_dots}, array(''), cast(array() AS array<string>))"
    return (
        f"CASE WHEN {path} = '' THEN ''"
        f" WHEN {matches(path, _DOTS)} THEN concat('/', array_join(concat({folded}, {folder}), '/'))"
        f" WHEN startswith({path}, '/') THEN {path} ELSE concat('/', {path}) END"
    )


def resolve_parts(base: str, ref: str) -> str:
    """RFC 3986 section 5.2.2 on two split URLs; gives a split URL with the host as written."""
    own_site = f"({_scheme(ref)} != '' OR {_authority(ref)} != '')"
    bare = f"(NOT {own_site} AND {_path(ref)} = '')"  # nothing but a query or fragment
    folder = extract(_path(base), r"(?s)^.*/")
    path = (
        f"CASE WHEN {own_site} OR startswith({_path(ref)}, '/') THEN {_path(ref)}"
        f" WHEN {bare} THEN {_path(base)} ELSE concat({folder}, {_path(ref)}) END"
    )
    keep_query = f"{bare} AND {_query(ref)} = ''"
    resolved = (
        f"array(if({_scheme(ref)} = '', {_scheme(base)}, {_scheme(ref)}),"
        f" if({own_site}, {_authority(ref)}, {_authority(base)}),"
        f" {let(path, _remove_dots)},"
        f" if({keep_query}, {_query(base)}, {_query(ref)}),"
        f" if({keep_query} AND {_fragment(ref)} = '', {_fragment(base)}, {_fragment(ref)}))"
    )
    return (
        f"CASE WHEN {base} IS NULL OR {ref} IS NULL THEN NULL"
        f" WHEN {_opaque(ref)} THEN {ref} ELSE {resolved} END"
    )


def resolve_url(base: str, ref: str) -> str:
    """Absolute form of ``ref`` as found on page ``base``; NULL if either is malformed."""
    return let(
        split_url(base),
        lambda b: let(split_url(ref), lambda r: let(resolve_parts(b, r), join_url)),
    )


def is_valid_url(url: str) -> str:
    """True for a parsable http or https URL."""
    return f"coalesce({_scheme(split_url(url))} IN ('http', 'https'), false)"


def url_host(url: str) -> str:
    """Host with port, without user info, in the case it was written."""
    return _host(_authority(split_url(url)))


def normalized_host(url: str) -> str:
    """Host of a URL that is already normalised; cheaper than :func:`url_host`."""
    return extract(url, r"^https?://(?:[^/?#]*@)?([^/?#]*)", 1)


def same_domain(left: str, right: str) -> str:
    """Hosts (with port) are byte-equal; the scheme does not matter."""
    return f"coalesce({url_host(left)} = {url_host(right)}, false)"


def allowlist_host(entry: str, *, lower: bool = True) -> str:
    """Host of an allowlist entry, which may be written with or without a scheme."""
    has_scheme = f"(startswith({entry}, 'http://') OR startswith({entry}, 'https://'))"
    host = let(f"if({has_scheme}, {entry}, concat('https://', {entry}))", url_host)
    return f"lower({host})" if lower else host


def url_filename(url: str, index: str) -> str:
    """File name for a page: host and path joined by ``_``, at most 200 bytes, plus ``.md``.

    ``index`` is the zero-based number used when the URL cannot be parsed or
    leaves nothing to build a name from.
    """
    numbered = f"format_string('page_%03d', {index} + 1)"

    def host_part(host: str) -> str:
        name = (
            f"if(startswith({host}, '['), {extract(host, '^.(.*)]', 1)},"
            f" {substitute(host, ':[0-9]*$', '')})"
        )
        return f"translate({name}, '.', '_')"

    def path_part(path: str) -> str:
        inner = f"translate({substitute(substitute(path, '^/', ''), '/$', '')}, {literal('/' + chr(92))}, '__')"
        return let(f"if({path} IN ('', '/'), 'index', {inner})", lambda text: cut_bytes(text, 100))

    def name(part: str) -> str:
        pieces = f"array({let(_host(_authority(part)), host_part)}, {let(_unescape(_path(part)), path_part)})"
        joined = f"array_join({keep(pieces, lambda piece: f'{piece} != {chr(39) * 2}')}, '_')"
        safe = f"translate({joined}, {literal(':*?<>|' + chr(34))}, '_______')"
        return let(safe, lambda text: f"if({text} = '', {numbered}, {cut_bytes(text, 200)})")

    return f"concat(coalesce({let(split_url(url), name)}, {numbered}), '.md')"
