"""Trains the chain of ``secrets`` on lines made here: python -m vertexloom.llm.secrets_train.

Secrets follow the published formats of token issuers or are random. Templates place them, and their
look-alikes (stand-ins, look-ups, digests, ids, field names), into lines of code, configuration and
prose as manuals show them; the characters of a secret are marked. Ordinary lines come from the
standard library of the interpreter that trains. Weights are fitted by stochastic gradient on the
regularised log-likelihood, and a held-out fifth of the lines is scored.
"""

from __future__ import annotations

import base64
import json
import math
import random
import string
import sysconfig
from collections import defaultdict
from pathlib import Path

from vertexloom.llm.secrets import MODEL, TOKEN, Crf, features

R = random.Random(17)
_ALNUM = string.ascii_letters + string.digits
_HEX = "0123456789abcdef"
_NOUNS = "apple river stone cloud maple falcon tiger comet delta ember forest glacier hazel iris jungle koala lemon mango north ocean pearl quartz raven solar tulip umbra velvet willow xenon yarrow zebra table report order user cache queue handler client server view model page index".split()
_USERS = "admin root app deploy alice bob backup reader writer ci svc service api".split()


def _chars(n: int, pool: str = _ALNUM) -> str:
    return "".join(R.choice(pool) for _ in range(n))


def _word() -> str:
    return R.choice(_NOUNS)


def _user() -> str:
    return R.choice([R.choice(_USERS), _word(), f"{R.choice(_USERS)}_{_word()}"])


def _name(lo: int = 2, hi: int = 5) -> str:
    return _chars(R.randint(lo, hi), string.ascii_lowercase)


def issued() -> str:
    """A token with a public issuer's prefix, or one of that form."""
    k = R.choice([0, 1, 2, 3, 4, 5, 7, 8])
    if k == 0:
        return R.choice(["ghp_", "gho_", "ghs_", "glpat-", "npm_", "hf_", "sk_live_", "rk_live_", "shpat_", "dop_v1_", "sk-", "key-", "pypi-", "lin_api_", "sk-ant-", "github_pat_"]) + _chars(R.randint(22, 40))
    if k == 1:
        return R.choice(["AKIA", "ASIA", "AIDA", "LTAI", _chars(R.randint(4, 5), string.ascii_uppercase)]) + _chars(16, string.ascii_uppercase + string.digits)
    if k == 2:
        return "AIza" + _chars(35, _ALNUM + "-_")
    if k == 3:
        return R.choice(["xoxb-", "xoxp-"]) + f"{_chars(11, string.digits)}-{_chars(12, string.digits)}-{_chars(24)}"
    if k == 4:
        return f"SG.{_chars(22)}.{_chars(43)}"
    if k == 5:
        part = lambda n: _chars(n, _ALNUM + "-_")
        return "eyJhbGciOi" + part(30) + "." + "eyJ" + part(50) + "." + part(43)
    return _name() + R.choice(["_", "-", "."]) + R.choice(["", _name(3, 5) + R.choice("_-")]) + _chars(R.randint(20, 40))


def passphrase() -> str:
    return R.choice([
        _word().title() + R.choice("!#+%x@$") + str(R.randint(10, 9999)) + _word(), _word() + str(R.randint(10, 9999)), "-".join(_word() for _ in range(3)) + "-" + str(R.randint(1, 99)), _word() + str(R.randint(1, 99)) + R.choice("!#%") + R.choice(["", _chars(1)]),
        _chars(R.randint(10, 14), _ALNUM + "!%*^-#"), _chars(R.randint(12, 24)), _word()[:2] + "3" + _word()[2:] + R.choice(["!", "7", "pw", "9x"]),
    ])


def random_secret() -> str:
    k = R.randrange(10)
    if k < 4:
        return passphrase()
    if k < 6:
        return issued()
    if k == 6:
        return _chars(R.choice([32, 40]), _HEX)
    if k == 7:
        return _chars(R.choice([32, 40, 44]), _ALNUM + "+/")
    if k == 8:
        h = _chars(32, _HEX)
        return f"{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:28]}." + _chars(20)
    return _chars(R.randint(14, 36))


def token_secret() -> str:
    return R.choice([issued, issued, lambda: _chars(R.choice([32, 36, 40])), lambda: _chars(40, _HEX)])()


def stand_in() -> str:
    return R.choice(["changeme", "CHANGE_ME", "REPLACE_ME", "********", "xxxxxxxxxxxxxxxx", "<your-key-here>", "<set at deploy time>", "<password>", "${VAULT_REF}", "${DB_PASSWORD}", "$SECRET", "your-token-here", "password", "secret", "example", "...", "dummy", "<token>", "not_set", "{{ secret }}", "%PASSWORD%", "redacted", "XXXX", "todo", "", "none"])


def _path() -> str:
    return "/".join(_word() for _ in range(R.randint(2, 4))) + R.choice([".py", ".go", "", ".html", "_2.rs"])


def inert() -> tuple[str, str]:
    """(name, value) of something that looks random but opens nothing."""
    hexes = lambda n: _chars(n, _HEX)
    h = hexes(32)
    return R.choice([
        lambda: (R.choice(["sha256", "digest", "checksum", "commit", "etag", "fingerprint", "revision", "content_hash", "md5", "git_sha", "tree", "build_digest", "file_checksum", "sum"]), hexes(R.choice([32, 40, 64]))),
        lambda: (R.choice(["integrity", "sri", "subresource_integrity"]), R.choice(["sha512-", "sha256-", "sha384-"]) + _chars(86, _ALNUM + "+/") + "=="),
        lambda: (R.choice(["uuid", "request_id", "session_uuid", "job_id", "object_id", "trace_id", "correlation_id"]), f"{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}"),
        lambda: (R.choice(["logo", "icon", "image", "favicon", "background", "sprite_image"]), "data:image/png;base64," + _chars(R.randint(40, 90), _ALNUM + "+/")),
        lambda: (R.choice(["token_name", "password_label", "secret_header", "auth_header_name", "key_name", "password_field", "token_type"]), R.choice(["X-Auth-Token", "password", "api_key", "access_token", "X-Api-Key", "bearer", _word()])),
        lambda: (R.choice(["www_authenticate", "auth_realm", "challenge"]), R.choice(["Basic realm=site", "Bearer <token>", "Basic realm=" + _word(), "Bearer realm"])),
        lambda: (R.choice(["link", "docs", "next_page", "homepage", "url", "form", "permalink"]), R.choice([f"https://{_word()}-{R.randint(1, 40)}.{_word()}.example/in?page={R.randint(1, 40)}&rev={hexes(40)}", f"https://{_word()}.example/commit/{hexes(40)}", "ALTER USER app IDENTIFIED BY ?", f"postgres://app:****@{_word()}.{_word()}.example/db", f"https://{_word()}.example/{_word()}?id={hexes(32)}", "postgres://app:${DB_PASSWORD}@db.example/x", f"mysql://{_word()}:<password>@{_word()}.test/db"])),
        lambda: (_word() + "_" + _word(), R.choice([_word() + "-" + _word(), _word(), "a " + _word() + " of " + _word(), str(R.randint(1, 9999)), _path(), _word().upper() + "_" + str(R.randint(1, 300))])),
        lambda: (R.choice([_word() + "_" + _word(), _word()]), R.choice([_word() + str(R.randint(0, 99)), _word() + "-" + str(R.randint(0, 99)), _word().title() + str(R.randint(0, 999)), f"{_word()}/{R.randint(0, 9)}.{R.randint(0, 20)}.{R.randint(0, 9)}/{_path()}", f"{R.randint(0, 9)}.{R.randint(0, 20)}.{R.randint(0, 9)}-rc{R.randint(1, 9)}", f"{_word()}.{_word()}:{R.randint(80, 9999)}", f"{R.randint(1990, 2030)}-0{R.randint(1, 9)}-{R.randint(10, 28)}T{R.randint(10, 23)}:{R.randint(10, 59)}:00Z"])),
        lambda: (R.choice(["public_key", "ssh_public_key", "certificate", "cert"]), R.choice(["ssh-ed25519 AAAAC3NzaC1lZDI1NTE5" + _chars(40, _ALNUM + "+/"), "-----BEGIN CERTIFICATE-----", "MII" + _chars(61, _ALNUM + "+/")])),
    ])()


_SECRET_NAMES = "db_password admin_pass admin_password smtp_passwd root_password pwd master_pwd auth_token service_token api_key client_secret access_key signing_key webhook_secret private_token bearer session_key secret_key encryption_key login_password refresh_token api_token passphrase user_pwd ftp_pass jwt_secret account_key pgpassword mysql_pwd password secret token credentials hmac_key".split()
_PLAIN_NAMES = "value setting option param header config item data default field entry arg".split()


def _case(name: str) -> str:
    parts = name.split("_")
    return R.choice([name, name.upper(), parts[0] + "".join(p.title() for p in parts[1:]), "".join(p.title() for p in parts), "-".join(parts)])


def assign(name: str, value: str) -> str:
    n = _case(name)
    return R.choice([
        f'{n} = "{value}"', f"{n} = '{value}'", f'const {n} = "{value}";', f'const {n}: &str = "{value}";', f'var {n} = "{value}"', f'private const string {n} = "{value}";', f"  - {n}: {value}", f"{n}='{value}'", f'self.{n} = "{value}"', f'"{n}" => "{value}",', f'{n}: {value} # {_word()}',
        f'{n}: "{value}"', f"{n}: {value}", f"{n}={value}", f'  "{n}": "{value}",', f'"{n}": "{value}"', f'{n} := "{value}"', f'let {n} = "{value}";', f'var c={{"{n}":"{value}","n":0}};', f'export {n}="{value}"', f"export {n}={value}", f"ENV {n} {value}" if " " not in value else f"{n}: {value}",
    ])


def _b64(x: str) -> str:
    return base64.b64encode(x.encode()).decode()


def _library() -> list[str]:
    """Lines of the standard library, as examples of ordinary code and comments."""
    out = []
    for f in sorted(Path(sysconfig.get_paths()["stdlib"]).glob("*.py")):
        out += [x for x in f.read_text(encoding="utf-8", errors="replace").split("\n") if x.strip() and "passw" not in x.lower()]
    return out


_LINES = _library()
_PROSE = [x.strip(" #") for x in _LINES if x.count(" ") > 5 and not set(x) & set("={}[]<>\\|")]


def ordinary() -> str:
    k = R.random()
    if k < 0.4:
        return R.choice(_LINES)
    if k < 0.5:
        return R.choice(["// ", "# ", "  // ", "    # ", " * ", "-- ", "/// "]) + R.choice(_PROSE)
    w, v, n = _word(), _word(), R.randint(0, 999)
    if k > 0.95:
        return R.choice([f"{w}_{v} {R.choice(['=', '+=', '-=', ':=', '=='])} {R.randint(0, 99999)}", f"return {R.randint(0, 9999)}", f"except {v.title()}Error as err:", f"log = logging.getLogger(__name__)", f"// (c) {R.randint(1990, 2026)} see the licence file", f"# Copyright {R.randint(1990, 2026)} the {w} team", f"class {w.title()}{v.title()}:", f"namespace {w.title()}{v.title()}.Core {{", f"using {w.title()}{v.title()};", f"// {v.title()}s must {w} every {v} at least once."])
    if k > 0.85:  # names of several words in calls, types and strings
        camel = lambda: R.choice([str.lower, str.title])(_word()) + "".join(_word().title() for _ in range(R.randint(1, 3)))
        a, b, c = camel(), camel(), camel()
        return R.choice([f"{a}.{b}({c}, {v});", f"return new {a}({b}.{c}, {n});", f"const {a} = await {b}({c});", f"private readonly {a} _{b};", f"throw new {a}Exception($\"{v} {{{b}}} of {c}\");", f"public async Task<{a}> {b}({c} {w})", f'"{a}": "{b}",', f"if ({a}.{b} > {c}.Length) {{", f"let {a}: {b}<{c}> = {w}.{v}();", f"func ({w[0]} *{a}) {b}({w} {c}) error {{", f"{a}: {b};", f'{w} := "{a}"', f"// {a} calls {b} when the {c} is done", f"impl {a} for {b}<{c}> {{", f"fmt.Errorf(\"{a}: %w\", {b})", f"<{a} {w}={{{b}}} />", f"{w}['{a}'] = '{b}';"])
    if k < 0.6:  # names that count up, file names with versions
        a = R.choice([w.title() + v.title() + str(n), f"{w}_{v}_{n}", f"{w}{n}", f"{w}{v.title()}{n}", f"{w.upper()}_{n}"])
        at = f"{R.randint(0, 9)}.{R.randint(0, 20)}.{R.randint(0, 9)}"
        if R.random() < 0.3:
            return R.choice(["// ", "# ", " * ", "", '  "']) + R.choice([f"{R.choice(['from', 'requires', 'pinned', 'built with', 'copied from', 'see'])} {w}{v}@{at}", f"mail {w}.{v}@{_word()}.example", f"{w}@{_word()}.com wrote {v}", f"@@{w.upper()}@@", f"git@{_word()}.com:{w}/{v}.git", f"uses: {w}/{v}@v{n}", f"ssh {w}@{_word()}-{n}.example"])
        return R.choice([f"public int {a} {{ get {{ return _f[{n}]; }} set {{ _f[{n}] = value; }} }}", f"    def {a}(self): return self.{v}[{n}]", f"int {a} = {n};", f"{a}: number;", f"let {a} = {w}({n});", f"{w}.{a}({v}, {n});", f"  {a},", f"{w.upper()}_{v.upper()}={a}", f"// {R.choice(['from', 'see', 'source', 'based on'])}: {w}{v}/{R.randint(0, 9)}.{R.randint(0, 20)}.{R.randint(0, 9)}/{_path()}, changed at {R.randint(1, 99)}", f"# {w}-{v}@{R.randint(0, 9)}.{R.randint(0, 20)}.{R.randint(0, 9)}", f'"{a}": {n},', f'"{a}",', f"func {a}({v} int) ({w} int) {{", f"pub fn {a}(&self) -> u64 {{ self.f[{n}] }}"])
    return R.choice([
        f"    {w.upper()}_{v.upper()}_{R.randint(1, 400)} = {R.randint(1, 400)},", f"func (x *{w.title()}Store) Get{v.title()}{R.randint(0, 20)}() int {{", f'"{w}-{v}": "{R.randint(1, 9)}.{R.randint(0, 9)}.{R.randint(0, 9)}",', f'  "resolved": "https://registry.example/{w}/-/{v}-{R.randint(1, 9)}.{R.randint(0, 9)}.0.tgz",',
        f"fn {w}_{v}(x: &mut u64, y: Vec<{w.title()}>) -> Result<u64, {v.title()}Error> {{", f"console.log(`{w} ${{{v}.length}} of {R.randint(1, 99)}`);", f"if ({w}.{v} !== null && {v}[{R.randint(0, 9)}] >= 0x{_chars(4, _HEX)}) {{", f"// The **{w}** of day **{R.randint(1, 300)}** costs {R.randint(1, 900)}. **Each** {v} counts.", f"var {w} = new {v.title()}<string, int>({R.randint(1, 64)}) {{ {w.title()} = {v} }};",
        f"def test_{w}_{v}_{R.randint(1, 99)}(self, {w}):", f'"{_chars(R.randint(8, 80), _ALNUM + "+/")}",', f'"{_chars(R.randint(8, 80))}"', _chars(64, _ALNUM + "+/"), f"-----BEGIN {R.choice(['CERTIFICATE', 'PUBLIC KEY', 'CERTIFICATE REQUEST'])}-----", f'<a href="{_path()}" class="{w}-{v}">{w} {v}</a>', f"| {w} | {v} | {R.randint(1, 99)} |", f"* {w.title()} {v}s are `{w}_{v}` and **not** {w}.",
        f"<Error><Code>{w.title()}{v.title()}</Code><RequestId>{_chars(16, _HEX)}</RequestId></Error>", f"<<<<<<< {w}", f">>>>>>> {_chars(7, _HEX)} ({w} {v})", f"index {_chars(7, _HEX)}..{_chars(7, _HEX)} 100644", f"let {w} = {v}.iter().map(|x| x * {R.randint(2, 9)}).sum::<u64>();", f'import {{ {w}{v.title()} }} from "./{_path()}";', f"log.info(\"{w} %s of %d\", {v}_{w}, n{R.randint(1, 9)})", f"{w}({v}, {R.randint(1, 99)}, \"{_word()}-{_word()}\", '{_word()} {_word()}')",
    ])


def line() -> tuple[str, list[str]]:
    """(text, the secrets in it)."""
    host = f"{_word()}{R.choice(['', '-' + str(R.randint(1, 40))])}.{_word()}.{R.choice(['example', 'invalid', 'test', 'com', 'internal'])}"
    cm = R.choice(["// ", "# ", "  // ", "# ", "-- ", " * "])
    if R.random() < 0.3:
        return ordinary(), []
    k = R.random()
    s, t = random_secret(), token_secret()
    if k < 0.19:
        return assign(R.choice(_SECRET_NAMES), s), [s]
    if k < 0.22:
        t = issued()
        return assign(R.choice([f"{R.choice(_PLAIN_NAMES)}_{R.choice(['one', 'two', 'a', 'x', '1'])}", R.choice(_PLAIN_NAMES), _word()]), t) if ":" not in t else assign(R.choice(_SECRET_NAMES), t), [t]
    if k < 0.27:
        return assign(R.choice(["database_url", "broker_url", "dsn", "redis_url", "uri", "mirror", "remote", "endpoint", "connection"]), f"{R.choice(['amqp', 'mysql', 'pgsql', 'postgres', 'postgresql', 'redis', 'https', 'mongodb', 'ftp', 'smtp'])}://{_user()}:{s}@{host}{R.choice(['', ':' + str(R.randint(1000, 9999))])}/{_word()}"), [s]
    if k < 0.31:
        return assign(R.choice(["conn", "connection_string", "db", "default_connection"]), R.choice([f"Server={host};Database={_word()};Uid=app;{R.choice(['Pwd', 'Password', 'PWD'])}={s};", f"host={host} user={_user()} password={s} dbname={_word()}", f"Data Source={host};User ID={_user()};Password={s};Encrypt=True"])), [s]
    if k < 0.35:
        return assign(R.choice(["webhook", "callback", "endpoint", "url", "feed"]), f"https://{host}/{R.choice(['in', 'v1/' + _word(), 'api'])}?{R.choice(['', 'page=2&'])}{R.choice(['access_token', 'sig', 'auth', 'key', 'token', 'api_key', 'signature'])}={t}"), [t]
    if k < 0.39:
        b = _b64(f"{_user()}:{s}")
        return R.choice([assign(R.choice(["auth_header", "authorization"]), "Basic " + b), f"curl -H 'Authorization: Basic {b}' https://{host}/v1", f'req.Header.Set("Authorization", "Basic {b}")']), [b]
    if k < 0.44:
        return R.choice([
            f"{R.choice(['rotate', 'connect', 'open', _word()])}_{_word()}(\"{_user()}\", password=\"{s}\")", f"{_word()}{_word().title()}(\"{_user()}\", password = \"{s}\");", f"login(user='{_user()}', secret='{s}')", f'{_word()}.{R.choice(["login", "authenticate", "Login", "auth", "signIn", "set_password", "setPassword"])}("{_user()}", "{s}")', f"{R.choice(['client', 'session', 'conn'])}.login('{_user()}', '{s}');",
            f"mysql -u {_user()} -p{s} {_word()}" if False else f"sshpass -p '{s}' ssh {_user()}@{host}", f"{_word()}.{_word()}(url, {{ {R.choice(['password', 'token', 'apiKey'])}: '{s}' }});", f"new {_word().title()}Client(\"{host}\", apiKey: \"{s}\");",
        ]), [s]
    if k < 0.49:
        x = R.choice([s, t])
        return cm + R.choice([f"token for {_word()}: {x}", f"TODO remove: password={x}", f"curl -u {_user()}:{x} https://{host}/{_word()}", f"temporary key: {x}", f"admin password is {x}", f"use token {x} for now", f"FIXME hard-coded secret {x}", f"pass: {x}", f"old credentials, still valid: {x}", f"login with {_user()} / password {x}"]), [x]
    if k < 0.52:
        return R.choice([f"curl -H 'Authorization: Bearer {t}' https://{host}/v1", f'headers = {{"Authorization": "Bearer {t}"}}', f"Authorization: Bearer {t}", f"X-Api-Key: {t}"]), [t]
    if k < 0.55:
        x = f"{R.choice(['ALTER', 'CREATE'])} USER {_user()} IDENTIFIED BY '{s}'"
        return R.choice([assign(R.choice(["statement", "sql", "query", "setup", "ddl"]), x), x + ";", f"CREATE ROLE {_user()} WITH LOGIN PASSWORD '{s}';", f'db.execute("{x}")']), [s]
    if k < 0.58:
        return R.choice([f"Log in as {_user()} with password `{s}`.", f"Sign in as `{_user()}` with the password `{s}`.", f"Password: {s}", f"The default password is `{s}`", f"Connect as {_user()} with password {s} and run it.", f"user {_user()}, password {s}"]), [s]
    if k < 0.605:
        b = _b64(R.choice([s, passphrase()]))
        return f"{_case(R.choice(['bearer', 'private_token', 'api_key', 'db_password', 'password', 'secret']))}{R.choice(['_b64', '', '_base64'])}{R.choice([': ', '=', ': '])}{b}", [b]
    if k < 0.63:
        a, b = _chars(R.randint(12, 20)), _chars(R.randint(12, 20))
        return assign(R.choice(_SECRET_NAMES), a + R.choice(['" + "', '" "', '" . "']) + b), [a, b]
    if k < 0.70:
        n = R.choice(_SECRET_NAMES)
        return R.choice([assign(n + R.choice(["", "_ref", "_file", "_field", "_name"]), stand_in()), f"const {_case(n)} = process.env.{n.upper()};", f'{n} = os.environ["{n.upper()}"]', f'var {_case(n)} = os.Getenv("{n.upper()}_REF")', f"let {n} = std::env::var(\"{n.upper()}\");", f"{n}: ${{{n.upper()}_REF}}", f'{n} = vault.read("{_word()}/{_word()}")', f"{n} = config.get('{n}')", f"if {n} != stored_{n}:", f"def check_{n}(user, {n}):", f"return {n}.validate({R.randint(1, 99)})", f"{n}: ${{{{ secrets.{n.upper()} }}}}"]), []
    if k < 0.74:
        n = R.choice(_SECRET_NAMES)
        return R.choice([f"{cm}{n}=... is passed on the command line", cm + "the token is read from the vault, never stored here", cm + f"password must have {R.randint(8, 20)} characters; secret rotation is weekly", "Set `API_KEY=<your-key-here>` first.", "Use `password: changeme` only as a stand-in and replace it.", f"The build digest is `{_chars(64, _HEX)}`.", cm + "see the auth guide for " + _word(), f"import {{ auth{_word().title()} }} from './auth_{_word()}';", f'log.info("token refreshed for", {_word()}_{_word()})', f"{_word()}_{_word()}(token, {R.randint(1, 9999)})", f"{cm}pass the {_word()} token to {_word()}_{_word()}", f"{cm}Never log the password of {_word()}s or their secret {_word()}."]), []
    if k < 0.84:
        return assign(*inert()), []
    return ordinary(), []


#: Features of a token alone that may rule it out.
SHAPES = ("len=", "uuid", "sri", "standin", "p=", "word", "camel", "dashed", "hex=", "cls=")


def example() -> tuple[list[list[str]], list[int]]:
    text, secrets = line()
    bounds = []
    at = 0
    for s in secrets:
        at = text.index(s, at)
        bounds.append((at, at + len(s)))
        at += len(s)
    got = [(m.start(), m.end(), m[0]) for m in TOKEN.finditer(text)]
    labels = [int(any(a <= lo and hi <= b for a, b in bounds)) for lo, hi, _ in got]
    return features([t for _, _, t in got], text), labels


def train(n: int = 30000, epochs: int = 6, rate: float = 0.3, ridge: float = 1e-5) -> tuple[Crf, float, float]:
    data = [x for x in (example() for _ in range(n)) if x[0]]
    held, data = data[: n // 5], data[n // 5 :]
    w: dict[str, float] = defaultdict(float)
    squares: dict[str, float] = defaultdict(lambda: 1e-2)
    moves, msq = [[0.0, 0.0], [0.0, 0.0]], [[1e-2] * 2, [1e-2] * 2]
    for _ in range(epochs):
        R.shuffle(data)
        for feats, ys in data:
            s = [sum(w[f] for f in fs) for fs in feats]
            n_ = len(s)
            add = lambda a, b: max(a, b) + math.log1p(math.exp(-abs(a - b)))
            fw = [(0.0, s[0])]
            for x in s[1:]:
                a, b = fw[-1]
                fw.append((add(a + moves[0][0], b + moves[1][0]), add(a + moves[0][1], b + moves[1][1]) + x))
            bw = [(0.0, 0.0)]
            for x in reversed(s[1:]):
                a, b = bw[-1]
                bw.append((add(moves[0][0] + a, moves[0][1] + x + b), add(moves[1][0] + a, moves[1][1] + x + b)))
            bw.reverse()
            z = add(*fw[-1])
            for k in range(n_):
                g = math.exp(fw[k][1] + bw[k][1] - z) - ys[k]
                if abs(g) > 1e-4:
                    for f in feats[k]:
                        d = g + ridge * w[f]
                        squares[f] += d * d
                        w[f] -= rate * d / math.sqrt(squares[f])
                if k:
                    for i in (0, 1):
                        for j in (0, 1):
                            d = math.exp(fw[k - 1][i] + moves[i][j] + (s[k] if j else 0) + bw[k][j] - z) - (ys[k - 1] == i and ys[k] == j)
                            msq[i][j] += d * d
                            moves[i][j] -= rate * d / math.sqrt(msq[i][j])
    # A shape that no marked token has is never marked: likelihood alone would push its weight down for ever.
    for f in {f for feats, ys in data for fs, y in zip(feats, ys) for f in fs if f.startswith(SHAPES)} - {f for feats, ys in data for fs, y in zip(feats, ys) if y for f in fs}:
        w[f] = min(w[f], -80.0)
    w["len=1"] = -80.0  # nor is a single letter or digit, though some stand in secrets
    crf = Crf({f: round(x, 3) for f, x in sorted(w.items()) if abs(x) >= 0.02}, [[round(x, 3) for x in r] for r in moves])
    hit = said = true = 0
    for feats, ys in held:
        got = crf.viterbi(feats)
        said += sum(got)
        true += sum(ys)
        hit += sum(a and b for a, b in zip(got, ys))
    return crf, hit / max(1, said), hit / max(1, true)


if __name__ == "__main__":
    crf, precision, recall = train()
    MODEL.write_text(json.dumps({"weights": crf.weights, "moves": crf.moves}, indent=0) + "\n")
    print(f"{len(crf.weights)} weights; held-out tokens: precision {precision:.4f}, recall {recall:.4f}")
