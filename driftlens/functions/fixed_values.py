"""Names, patterns and tiers that results depend on. Plain text, natural order.

Larger lists (popular package names, disposable mail domains) are inputs, read from files the
caller supplies; see ``driftlens.sources.lists``.
"""

# --- module classes, JavaScript -------------------------------------------------------------
NETWORK_MODULES = [
    "http", "https", "net", "dgram", "tls", "undici", "axios", "node-fetch", "got", "request",
    "superagent", "ws", "node:http", "node:https", "node:net", "node:dgram", "node:tls",
    "dns", "dns/promises", "node:dns", "node:dns/promises",
]
EXEC_MODULES = [
    "child_process", "worker_threads", "vm", "inspector", "async_hooks", "trace_events", "perf_hooks",
    "node:child_process", "node:worker_threads", "node:vm", "node:inspector", "node:async_hooks",
    "node:trace_events", "node:perf_hooks",
]
FS_MODULES = ["fs", "fs/promises", "node:fs", "node:fs/promises", "graceful-fs"]
DNS_MODULES = ["dns", "dns/promises", "node:dns", "node:dns/promises"]
NETWORK_CALL_NAMES = [
    "fetch", "request", "get", "post", "put", "delete", "head", "options", "connect", "trace",
    "axios", "http", "https", "superagent",
]
CONFIG_KEY_NAMES = [
    "url", "href", "endpoint", "baseURL", "uri", "api", "host", "server", "target", "dest", "destination",
]

# --- module classes, Python -----------------------------------------------------------------
PY_NETWORK_MODULES = [
    "urllib", "urllib.request", "urllib.parse", "urllib.error", "http", "http.client", "http.server",
    "socket", "socketserver", "ssl", "ftplib", "smtplib", "poplib", "imaplib", "telnetlib", "nntplib",
    "asyncio", "asyncio.streams", "socket.gethostbyname", "socket.getaddrinfo", "requests", "httpx",
    "aiohttp", "urllib3", "httplib2", "websocket", "websockets", "ws4py", "paramiko", "fabric", "pexpect",
]
PY_EXEC_MODULES = [
    "subprocess", "os.system", "os.popen", "os.spawn", "os.exec", "popen2", "commands",
    "multiprocessing", "threading", "ctypes", "cffi", "pty", "shlex", "importlib", "importlib.util",
    "importlib.machinery", "imp", "code", "codeop", "ast",
]
PY_FS_MODULES = ["os", "os.path", "shutil", "pathlib", "io", "tempfile", "glob", "fnmatch", "stat"]

# --- environment names whose reading is sensitive -------------------------------------------
SENSITIVE_ENV_KEYS = """
NPM_TOKEN NPM_AUTH_TOKEN NPM_CONFIG_TOKEN GITHUB_TOKEN GH_TOKEN GH_PAT GITHUB_PAT
AWS_ACCESS_KEY_ID AWS_SECRET_ACCESS_KEY AWS_SESSION_TOKEN AWS_PROFILE AWS_DEFAULT_REGION
GOOGLE_APPLICATION_CREDENTIALS GCP_TOKEN GOOGLE_API_KEY GOOGLE_PRIVATE_KEY GCP_SERVICE_ACCOUNT_KEY
AZURE_CLIENT_ID AZURE_CLIENT_SECRET AZURE_TENANT_ID AZURE_STORAGE_KEY OKTA_CLIENT_SECRET
DOCKER_AUTH_CONFIG DOCKER_PASSWORD DOCKER_USERNAME REGISTRY_PASSWORD
STRIPE_SECRET_KEY STRIPE_API_KEY STRIPE_WEBHOOK_SECRET PAYPAL_CLIENT_SECRET SQUARE_ACCESS_TOKEN
HEROKU_API_KEY NETLIFY_AUTH_TOKEN VERCEL_TOKEN SUPABASE_KEY SUPABASE_SERVICE_ROLE_KEY
SUPABASE_JWT_SECRET PLANETSCALE_TOKEN FIREBASE_TOKEN FIREBASE_API_KEY CLOUDFLARE_API_TOKEN
CLOUDFLARE_ACCOUNT_ID DIGITALOCEAN_TOKEN DIGITALOCEAN_ACCESS_TOKEN
SLACK_TOKEN SLACK_BOT_TOKEN SLACK_SIGNING_SECRET SLACK_WEBHOOK_URL DISCORD_BOT_TOKEN DISCORD_TOKEN
DISCORD_WEBHOOK TELEGRAM_BOT_TOKEN TWILIO_AUTH_TOKEN SMTP_PASS SMTP_PASSWORD EMAIL_PASSWORD
SENTRY_AUTH_TOKEN SENTRY_DSN DATADOG_API_KEY DD_API_KEY NEW_RELIC_LICENSE_KEY
OPENAI_API_KEY ANTHROPIC_API_KEY HUGGINGFACEHUB_API_TOKEN CO_API_KEY
MNEMONIC PRIVATE_KEY WALLET_PRIVATE_KEY ETH_PRIVATE_KEY BTC_PRIVATE_KEY SOLANA_PRIVATE_KEY SEED_PHRASE
METAMASK_SEED PHANTOM_PRIVATE_KEY PGP_PRIVATE_KEY GPG_PRIVATE_KEY SSH_PRIVATE_KEY DEPLOY_KEY
JWT_SECRET JWT_PRIVATE_KEY AUTH_SECRET SESSION_SECRET COOKIE_SECRET
DATABASE_URL DB_URL MONGO_URL MONGODB_URI REDIS_URL POSTGRES_URL DB_PASSWORD DATABASE_PASSWORD
MAILGUN_API_KEY SENDGRID_API_KEY POSTMARK_API_TOKEN PYPI_TOKEN TWINE_PASSWORD VAULT_TOKEN VAULT_SECRET
USER USERNAME SSH_AUTH_SOCK GPG_AGENT_INFO
""".split()

# --- sensitive file paths -------------------------------------------------------------------
HOT_PATHS_ANY_CASE = [
    r"\.ssh(/|\z)", r"(^|/)\.npmrc\z", r"(^|/)\.git/config\z", r"(^|/)\.git-credentials\z",
    r"(^|/)id_rsa", r"(^|/)id_ed25519", r"\.aws/credentials", r"\.docker/config\.json",
    r"(^|/)netrc\z", r"(^|/)\.netrc\z", r"wallet\.dat", r"keystore", r"(^|/)keychain",
    r"Ethereum/keystore", r"(^|/)\.electrum", r"Solana/id\.json", r"\.bash_history", r"\.zsh_history",
    r"(^|/)Local Storage(/|\z)", r"(^|/)IndexedDB(/|\z)", r"BrowserData", r"^C:\\Windows",
]
HOT_PATHS_EXACT_CASE = [
    r"(^|/)Desktop(/|\z)", r"(^|/)Documents(/|\z)", r"^~", r"^/etc/", r"^/root/", r"^/var/log/",
]
SENSITIVE_PATH_HINTS = [
    r"\.npmrc", r"\.ssh", r"id_rsa", r"\.aws/", r"wallet", r"keystore", r"keychain", r"\.git/config",
    r"\.bash_history", r"\.zsh_history", r"Local Storage", r"Ethereum", r"Solana", r"/etc/", r"/root/",
    r"Desktop", r"Documents",
]

# --- lifecycle hooks ------------------------------------------------------------------------
INSTALL_HOOKS = [
    "preinstall", "install", "postinstall", "preuninstall", "uninstall", "postuninstall", "preinstalled",
]
PREPARE_HOOKS = ["preprepare", "prepare", "postprepare"]
PUBLISH_HOOKS = [
    "prepublish", "prepublishOnly", "publish", "postpublish", "prepack", "pack", "postpack",
    "preversion", "version", "postversion", "preshrinkwrap", "shrinkwrap", "postshrinkwrap",
]
CI_HOOKS = [
    "test", "prestart", "start", "poststart", "prestop", "stop", "poststop",
    "prerestart", "restart", "postrestart",
]
BUNDLED_HOOKS = [
    "preinstall", "install", "postinstall", "prepare", "preprepare", "postprepare", "prepublish",
    "prepublishOnly", "publish", "postpublish", "prepack", "pack", "postpack",
]
SELF_PUBLISH_HOOKS = ["preinstall", "install", "postinstall", "prepare"]

# --- registries, images, build folders ------------------------------------------------------
REGISTRY_HOSTS = ["registry.npmjs.org", "registry.yarnpkg.com", "registry.npmmirror.com", "npm.pkg.github.com"]
IMAGE_SUFFIX = r"(?i)\.(png|jpg|jpeg|gif|bmp|webp|tiff|ico)\z"
BUILD_DIR = r"^(dist|build|lib|es|esm|cjs|mjs|umd|out|bundle|compiled)/"
JS_SOURCE = r"(?i)\.(m?js|cjs|jsx|ts|tsx)\z"
ANALYZABLE_SOURCE = r"(?i)\.(m?js|cjs|jsx|ts|tsx|json)\z"
PY_SOURCE = r"(?i)\.(py|pyi|pyx)\z"
NATIVE_SUFFIX = r"(?i)\.(node|so|dylib|dll|exe|wasm|bin)\z"
PY_NATIVE_SUFFIX = r"(?i)\.(so|dylib|dll|exe|wasm|bin|pyd)\z"
MEDIA_SUFFIX = r"(?i)\.(jpg|jpeg|png|gif|webp|ttf|woff|woff2|svg|ico)\z"

# --- text patterns --------------------------------------------------------------------------
MANGLED_ID = r"_0x[a-f0-9]{4,6}\b"
DNS_CALLEE = r"\b(?:dns\.(?:lookup|resolve\w*|reverse)|getaddrinfo|gethostbyname|nslookup)\s*\("
# ASCII letters touching Greek, Cyrillic, Cherokee or mathematical alphanumerics
CONFUSABLE_CLASS = "[\u0370-\u03ff\u0400-\u04ff\u13a0-\u13ff\U0001d400-\U0001d7ff]"
# bare-host endings; the first group also names file suffixes, so it needs a following : / ? or #
AMBIGUOUS_TLDS = "app dev io co name pro tech".split()
PLAIN_TLDS = """
com net org cloud site xyz ru cn tk ml ga cf invalid top pw zip click info us biz mobi icu host online
club work stream party science today link fit men rest space store shop world life guru example test
localhost
""".split()
PY_TLDS = """
com net org io dev co app xyz ru cn tk ml ga cf invalid top pw zip click info us biz mobi icu host online
club cloud site work stream party science today link fit men rest space store shop tech world life guru
pro name example test localhost
""".split()

# --- WebAssembly imports --------------------------------------------------------------------
WASM_HOST_MODULE = r"(?i)^(env|imports|host)\z"
WASI_MODULE = r"(?i)^wasi_snapshot_preview[12]\z"
WASI_NAMES = r"(?i)^(fd_write|fd_read|path_open|proc_exec|sock_send|sock_recv)\z"
WASM_NAMES = (
    r"(?i)^(?:[\w$-]+\.)?(?:eval|Function|fetch|XMLHttpRequest|open|write|read|spawn|exec|system|popen|shell"
    r"|curl|wget|connect|send|recv|download|upload|readFile|writeFile)\z"
)

# --- escalation -----------------------------------------------------------------------------
DANGEROUS_CODE_KINDS = ["eval", "new-function", "unpacker", "marshal", "deserialize"]
OBF_PARTNER_CATEGORIES = ["NET", "INSTALL", "EXEC", "ENV", "FS"]
CAPABILITY_CATEGORIES = ["NET", "INSTALL", "EXEC", "ENV", "FS", "CODE", "OBF"]
CATEGORIES = ["NET", "EXEC", "FS", "ENV", "CODE", "OBF", "INSTALL", "META", "DEPS", "INTEG"]
ATTACK_PAIRS = [
    ("NET", "ENV"), ("NET", "EXEC"), ("NET", "INSTALL"),
    ("ENV", "EXEC"), ("ENV", "INSTALL"), ("EXEC", "INSTALL"),
]
ALWAYS_APPLY = ["integrity.hash-mismatch", "analysis.failed"]

# --- technique tags -------------------------------------------------------------------------
TECHNIQUE_TAGS = {
    "install.script-added": ["T1195.002", "T1059.007"],
    "install.script-changed": ["T1195.002", "T1059.007"],
    "install.bundled-lifecycle": ["T1195.002", "T1059.007"],
    "meta.maintainer-change": ["T1078", "T1195.002"],
    "net.new-module": ["T1071.001", "T1041"],
    "net.new-endpoint": ["T1071.001", "T1041", "T1567"],
    "net.encoded-endpoint": ["T1027", "T1140", "T1573"],
    "exec.new-module": ["T1059.007", "T1059"],
    "fs.new-hotpath-write": ["T1547", "T1554"],
    "fs.new-hotpath-read": ["T1552.001", "T1005"],
    "env.token-harvest": ["T1552.001", "T1074"],
    "code.dynamic-loading-added": ["T1059.007", "T1140", "T1105"],
    "obf.entropy-jump": ["T1027", "T1140"],
    "obf.new-obfuscated-file": ["T1027", "T1140"],
    "bin.new-native-artifact": ["T1554", "T1027"],
    "wasm.suspicious-import": ["T1027", "T1055"],
    "wasm.unparseable": ["T1027"],
    "deps.new-direct-dep": ["T1195.002"],
    "deps.typosquat-candidate": ["T1036.005", "T1195.002", "T1583.001"],
    "deps.first-version-cluster": ["T1195.002", "T1608.001"],
    "deps.bundled-dependency-added": ["T1195.002", "T1027"],
    "deps.workspace-shadowing": ["T1036.005", "T1195.002"],
    "deps.aliased-name": ["T1036.005", "T1195.002"],
    "deps.non-registry-source": ["T1195.002"],
    "deps.local-source": ["T1195.002"],
    "integrity.hash-mismatch": ["T1554", "T1195.002"],
    "analysis.failed": ["T1027"],
    "config.in-diff-untrusted": ["T1195.002"],
}

# --- advisories: id, cve, package, affected ranges, severity ---------------------------------
ADVISORIES = [
    ("GHSA-fh58-9fw3-vf2v", None, "ua-parser-js", "=0.7.29 || =0.8.0 || =1.0.0", "critical"),
    ("GHSA-mh6f-8j2x-4483", None, "coa", ">=2.0.3 <=2.1.3", "critical"),
    ("GHSA-g2q5-5433-rhrf", None, "rc", "=1.2.9 || =1.3.9 || =2.3.9", "critical"),
    ("GHSA-mh63-6h87-95cp", None, "event-stream", "=3.3.6", "critical"),
    ("GHSA-jf85-cpcp-j695", None, "colors", "=1.4.1 || >=1.4.44-liberty-2", "high"),
    ("GHSA-8v38-pw62-9cw2", None, "node-ipc", ">=9.2.2 <10.0.0 || >=10.1.1 <=10.1.2 || =11.0.0", "critical"),
    ("GHSA-5qgm-9j92-h5g5", None, "eslint-scope", "=3.7.2 || =4.0.1", "critical"),
    ("GHSA-jj35-jhw9-vp4q", None, "@solana/web3.js", ">=1.95.5 <=1.95.7", "critical"),
    ("GHSA-cwfw-4gq5-mrqx", None, "@lottiefiles/lottie-player", ">=2.0.5 <=2.0.7", "critical"),
    ("GHSA-3xgq-45jj-v275", "CVE-2023-26136", "tough-cookie", "<4.1.3", "moderate"),
    ("GHSA-x2pg-mjhr-2m5x", "CVE-2023-45857", "axios", "<0.28.0 || >=1.0.0 <1.6.0", "moderate"),
]

# --- publishers expected for well-known packages ----------------------------------------------
TRUSTED_PUBLISHERS = {
    "chalk": ["sindresorhus", "qix-"],
    "ansi-styles": ["sindresorhus", "qix-"],
    "strip-ansi": ["sindresorhus"],
    "ora": ["sindresorhus"],
    "debug": ["tjholowaychuk", "dougwilson", "qix-"],
    "ms": ["tjholowaychuk", "dougwilson"],
    "express": ["dougwilson", "blakeembrey"],
    "body-parser": ["dougwilson"],
    "npm": ["@npmjs.com"],
    "semver": ["isaacs", "@npmjs.com"],
    "pacote": ["isaacs", "@npmjs.com"],
    "@actions/core": ["@github.com"],
    "@actions/github": ["@github.com"],
    "@github/hub": ["@github.com"],
    "@microsoft/tsdoc": ["@microsoft.com"],
    "@microsoft/api-extractor": ["@microsoft.com"],
    "typescript": ["@microsoft.com"],
    "@types/node": ["definitelytyped"],
    "@types/react": ["definitelytyped"],
    "@angular/core": ["@google.com", "@angular.io"],
    "@angular/common": ["@google.com", "@angular.io"],
    "react": ["@fb.com", "@meta.com"],
    "react-dom": ["@fb.com", "@meta.com"],
    "react-native": ["@fb.com", "@meta.com"],
    "next": ["@vercel.com", "@zeit.co"],
    "vite": ["yyx990803"],
    "vue": ["yyx990803"],
    "vue-router": ["yyx990803"],
    "webpack": ["sokra", "@webpack.js.org"],
    "@solana/web3.js": ["@solana.com", "@solana-labs.com"],
    "lodash": ["jdalton"],
    "moment": ["@momentjs.com"],
    "axios": ["@axios-http.com"],
    "jest": ["@facebook.com", "@meta.com"],
    "is-plain-obj": ["sindresorhus"],
    "p-limit": ["sindresorhus"],
    "p-queue": ["sindresorhus"],
    "p-map": ["sindresorhus"],
}

# --- incident records -----------------------------------------------------------------------
CATEGORY_CAPABILITY = {
    "NET": "net-egress", "EXEC": "code-execution", "FS": "fs-write", "ENV": "secret-read",
    "CODE": "code-execution", "OBF": "obfuscation-decode", "INSTALL": "code-execution",
    "META": "persistence", "INTEG": "code-execution", "DEPS": "code-execution",
}
ENTRY_POINTS = [  # (detector id prefix, entry point); anything else is main-import-side-effect
    ("install.", "install-script"),
    ("meta.maintainer", "maintainer-takeover"),
    ("deps.typosquat", "typosquat"),
    ("integrity.hash-mismatch", "integrity-tamper"),
    ("deps.local-source", "file-source"),
    ("deps.non-registry-source", "git-source"),
    ("deps.aliased-name", "alias-shadow"),
    ("deps.bundled-dependency", "bundled-payload"),
    ("deps.new-direct-dep", "transitive-injection"),
]
GATE_SECRETS = (
    r"(?i)\b(?:NPM_TOKEN|NODE_AUTH_TOKEN|GITHUB_TOKEN|GH_TOKEN|GITLAB_TOKEN|AWS_SECRET(?:_ACCESS_KEY)?"
    r"|AWS_ACCESS_KEY_ID|AZURE_CLIENT_SECRET|GOOGLE_APPLICATION_CREDENTIALS)\b"
)
CLASS_ALIASES = {
    "env/secret-read": ["secret-read", "fs-read"],
    "secret-read": ["env/secret-read"],
    "fs-read": ["env/secret-read"],
    "obfuscation/decode": ["obfuscation-decode"],
    "obfuscation-decode": ["obfuscation/decode"],
}
RESERVED_TLDS = ["invalid", "test", "example", "localhost"]
RESERVED_DOMAINS = ["example.com", "example.org", "example.net"]

# Python line rules, fixed values: (fact, patterns that the masked line must match (all), pattern of the raw line whose
# first group is the key, or None, key or site kind of rules without such a pattern). A second group of a pattern is the
# mode of an opened file. "exec" of compile is looked for in the raw line, where strings are kept.
PYTHON_LINE_RULES = [
    ("site", [r"\b__import__\s*\("], None, "dynamic-require"),
    ("site", [r"\bimportlib(?:\.util)?\.import_module\s*\("], None, "dynamic-require"),
    ("module", [r"\b__import__\s*\("], None, "importlib"),
    ("module", [r"\bimportlib(?:\.util)?\.import_module\s*\("], None, "importlib"),
    ("site", [r"\bexec\s*\("], None, "eval"),
    ("site", [r"\beval\s*\("], None, "eval"),
    ("site", [r"\bcompile\s*\("], r"\b(compile)\s*\([\s\S]*?['\"]exec['\"]", "new-function"),
    ("site", [r"\bmarshal\.loads?\s*\("], None, "new-function"),
    ("module", [r"\bmarshal\.loads?\s*\("], None, "marshal"),
    ("module", [r"\bsubprocess\.(?:run|call|Popen|check_output|check_call)\b"], None, "subprocess"),
    ("module", [r"\bos\.(?:system|popen|exec[lv][ep]?|spawn[lv][ep]?)\b"], None, "os.system"),
    ("env", [r"\bos\.environ\b"], r"\bos\.environ\.get\s*\(\s*['\"]([A-Z_][A-Z0-9_]*)['\"]", None),
    ("env", [r"\bos\.environ\b"], r"\bos\.environ\s*\[\s*['\"]([A-Z_][A-Z0-9_]*)['\"]", None),
    ("env", [r"\bfor\s+\w+(?:\s*,\s*\w+)?\s+in\s+os\.environ\b"], None, "*"),
    ("env", [r"\bdict\s*\(\s*os\.environ\b"], None, "*"),
    ("env", [r"\blist\s*\(\s*os\.environ\b"], None, "*"),
    ("env", [r"\{\s*\*\*\s*os\.environ\b"], None, "*"),
    ("env", [r"\bos\.environ\.(?:items|keys|values)\s*\("], None, "*"),
    ("env", [r"\bos\.getenv\b"], r"\bos\.getenv\s*\(\s*['\"]([A-Z_][A-Z0-9_]*)['\"]", None),
    ("open", [r"\bopen\s*\("], r"\bopen\s*\(\s*['\"]([^'\"]+)['\"]\s*,\s*['\"]([warxb+]{1,3})['\"]", None),
    ("fs_read", [r"\bopen\s*\("], r"\bopen\s*\(\s*['\"]([^'\"]+)['\"]\s*\)", None),
    ("fs_write", [r"\bPath\s*\("], r"\bPath\s*\(\s*['\"]([^'\"]+)['\"]\s*\)\s*\.\s*write_(?:text|bytes)", None),
    ("fs_read", [r"\bPath\s*\("], r"\bPath\s*\(\s*['\"]([^'\"]+)['\"]\s*\)\s*\.\s*read_(?:text|bytes)", None),
    ("fs_write", [r"\bshutil\."], r"\bshutil\.(?:copy|copyfile|move)\s*\(\s*['\"][^'\"]+['\"]\s*,\s*['\"]([^'\"]+)['\"]", None),
    ("fs_write", [r"\bos\.(?:remove|unlink|rmdir)\b"], r"\bos\.(?:remove|unlink|rmdir)\s*\(\s*['\"]([^'\"]+)['\"]", None),
]
WRITE_MODE = r"[wax+]"

# Whole-file shapes of Python, fixed values: patterns that must all occur, and words for the evidence.
PYTHON_FILE_SHAPES = [
    ([r"\bbase64\.b64decode\s*\(", r"\bexec\s*\("], "base64 decoding together with exec"),
    (["(?:''\\.join|\"\"\\.join)\\s*\\(\\s*\\[?\\s*chr\\s*\\("], "text joined from character codes"),
]

# Calls at the top level of setup.py, fixed values: label and pattern.
SETUP_CALLS = [
    ("os.system", r"\bos\.system\s*\("),
    ("subprocess.exec", r"\bsubprocess\.(?:run|call|Popen|check_output|check_call)\s*\("),
    ("os.popen", r"\bos\.popen\s*\("),
    ("urllib.urlopen", r"\burllib\.request\.urlopen\s*\("),
    ("requests.http", r"\brequests\.(?:get|post|put)\s*\("),
    ("httpx.http", r"\bhttpx\.(?:get|post|put)\s*\("),
    ("socket.socket", r"\bsocket\.socket\s*\("),
    ("exec", r"\bexec\s*\("),
    ("eval", r"\beval\s*\("),
]
SETUP_OVERRIDE = r"\bcmdclass\s*="
SETUP_OVERRIDE_HOOK = "[setup.py] custom cmdclass= override (install lifecycle hijack)"

# Hosts and commands that stored text must not hold in a form that works, fixed values as documented.
URL_HOST = r"(?i)(?:https?|ftp|ftps|ws|wss|file|smtp|smtps|imap|imaps|pop3|pop3s|ldap|ldaps|ssh|git)://((?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\.)+[a-z]{2,24})\b"
IPV4 = r"\b((?:\d{1,3}\.){3}\d{1,3})\b"
COMMANDS = [
    ("curl", r"(?i)\bcurl\s+[^\r\n;|&]{3,}"),
    ("wget", r"(?i)\bwget\s+[^\r\n;|&]{3,}"),
    ("nc", r"(?i)\bnc\s+[\w.:]+\s+\d+"),
    ("netcat", r"(?i)\bnetcat\s+[\w.:]+\s+\d+"),
    ("powershell", r"(?i)\bpowershell(?:\.exe)?\s+[^\r\n;|&]{2,}"),
    ("bash -c", r"(?i)\bbash\s+-c\s+(?:\"[^\"]*\"|'[^']*'|[^\r\n;|&]+)"),
    ("sh -c", r"(?i)\bsh\s+-c\s+(?:\"[^\"]*\"|'[^']*'|[^\r\n;|&]+)"),
    ("python -c", r"(?i)\bpython[23]?\s+-c\s+(?:\"[^\"]*\"|'[^']*'|[^\r\n;|&]+)"),
    ("node -e", r"(?i)\bnode\s+-e\s+(?:\"[^\"]*\"|'[^']*'|[^\r\n;|&]+)"),
]
FETCHING = ["nc", "netcat", "curl", "wget"]
HARMLESS_COMMANDS = ["echo", "printf", "true", "false", ":", "noop"]
ENCODED_RUNS = [r"[A-Za-z0-9+/]{80,}={0,2}", r"\b[0-9a-fA-F]{80,}\b"]
DECODE_CALLS = r"\b(atob|Buffer\.from|base64_decode|hex2bin|new\s+Function|eval)\s*\("
