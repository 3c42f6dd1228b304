"""The detection rules: a small ordered table that drives the regex scan.

Rules are configuration, not data: a set is built on the driver, is immutable,
and is turned into literal expressions (the scan) or a broadcast table (lookups).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keysift import schemas
from keysift.operators import literals

# The letters outside ASCII that a regex ignoring case takes for ASCII ones and that
# lower() does not map to them: long s, Kelvin sign, dotted I, dotless i.
FOLDING_LETTERS = "\u017f\u212a\u0130\u0131"

# Name, regex, keywords, description, confidence boost.
BUILT_IN = [
    ("aws_access_key", r"AKIA[0-9A-Z]{16}",
     ["aws", "access", "key", "akia"],
     "AWS Access Key ID", "0.3"),
    ("aws_secret_key", r"""(?i)aws(.{0,20})?["']?[0-9a-zA-Z/+=]{40}["']?""",
     ["aws", "secret", "key"],
     "AWS Secret Access Key", "0.2"),
    ("api_key_generic", r"""(?i)(api[_\-\s]?key|apikey)[\s]*[:=][\s]*["']?[a-zA-Z0-9\-_]{20,}["']?""",
     ["api", "key", "token", "bearer"],
     "Generic API Key", "0.1"),
    ("github_token", r"gh[ps]_[A-Za-z0-9]{36}",
     ["github", "token", "gh_", "ghs_", "ghp_"],
     "GitHub Personal Access Token", "0.4"),
    ("private_key", r"-----BEGIN (?:RSA |EC |DSA |OPENSSH )?PRIVATE KEY",
     ["private", "key", "rsa", "pem", "ssh"],
     "Private Cryptographic Key", "0.5"),
    ("password", r"""(?i)(password|passwd|pwd)[\s]*[:=][\s]*["']?[^\s"'{}<>]{8,}["']?""",
     ["password", "passwd", "pwd", "pass"],
     "Hardcoded Password", "0.1"),
    ("db_connection", r"""(?i)(mongodb\+srv|postgres|mysql|redis|amqp|jdbc):\/\/[^\s<>"{}\\^\[\]`]+""",
     ["connection", "database", "mongodb", "postgres", "mysql", "redis"],
     "Database Connection String", "0.3"),
    ("jwt_token", r"eyJ[A-Za-z0-9-_]+\.eyJ[A-Za-z0-9-_]+\.[A-Za-z0-9-_]+",
     ["jwt", "token", "bearer", "authorization"],
     "JWT Token", "0.4"),
    ("slack_token", r"xox[baprs]-[0-9]{10,12}-[0-9]{10,12}-[a-zA-Z0-9]{24,}",
     ["slack", "token", "xoxb", "xoxp"],
     "Slack Token", "0.4"),
    ("google_api", r"AIza[0-9A-Za-z\-_]{35}",
     ["google", "api", "key", "aiza"],
     "Google API Key", "0.3"),
    ("stripe_key", r"sk_live_[0-9a-zA-Z]{24}",
     ["stripe", "secret", "key", "sk_live"],
     "Stripe Secret Key (Live)", "0.4"),
    ("azure_connection", r"""(?i)azure(.{0,20})?["']?[A-Za-z0-9+/=]{50,}["']?""",
     ["azure", "connection", "storage", "account", "key"],
     "Azure Storage Account Key or Connection String", "0.3"),
    ("facebook_access_token", r"EAACEdEos0BA[ A-Za-z0-9]{50,}",
     ["facebook", "access", "token", "eaac"],
     "Facebook Access Token", "0.4"),
    ("twitter_api_key", r"""(?i)twitter(.{0,20})?["']?[A-Za-z0-9]{25,}["']?""",
     ["twitter", "api", "key", "secret", "bearer"],
     "Twitter API Key or Secret", "0.2"),
    ("ssh_private_key_id_rsa", r"-----BEGIN RSA PRIVATE KEY-----[\s\S]*?-----END RSA PRIVATE KEY-----",
     ["ssh", "id_rsa", "private", "key"],
     "Full SSH Private Key Block (RSA)", "0.5"),
    ("npm_token", r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}",
     ["npm", "token", "auth"],
     "NPM Authentication Token (UUID format)", "0.3"),
    ("docker_hub_token", r"eyJ[A-Za-z0-9-_]+\.eyJ[A-Za-z0-9-_]+\.[A-Za-z0-9-_]{50,}",
     ["docker", "hub", "token", "jwt"],
     "Docker Hub JWT Token (longer signature variant)", "0.3"),
    ("sendgrid_api_key", r"SG\.[A-Za-z0-9\-_]{22}\.[A-Za-z0-9\-_]{43}",
     ["sendgrid", "api", "key", "sg."],
     "SendGrid API Key", "0.4"),
    ("mailchimp_api_key", r"[0-9a-f]{32}-us[0-9]{1,2}",
     ["mailchimp", "api", "key"],
     "Mailchimp API Key", "0.3"),
    ("pypi_token", r"pypi-[A-Za-z0-9\-_]{30,}",
     ["pypi", "token", "upload"],
     "PyPI Upload Token", "0.4"),
    ("openssl_private_key", r"-----BEGIN OPENSSH PRIVATE KEY-----[\s\S]*?-----END OPENSSH PRIVATE KEY-----",
     ["openssl", "private", "key", "openssh"],
     "OpenSSH Private Key Block", "0.5"),
    ("cloudinary_creds", r"cloudinary://[0-9]{15,}:[A-Za-z0-9_]{20,}@[a-zA-Z0-9-]+",
     ["cloudinary", "api", "key", "secret"],
     "Cloudinary API Key and Secret in URL", "0.3"),
    ("s3_bucket_url", r"(?i)s3://[a-z0-9.-]+\.amazonaws\.com/[a-zA-Z0-9/_\-]{20,}",
     ["s3", "bucket", "aws", "amazon"],
     "AWS S3 Bucket URL with Potential Path Secrets", "0.2"),
]

# What any match of a built-in rule contains: of each group one literal, lower case for
# the rules that ignore case. The first group is common to several rules or rare. They
# only let the scan skip a regex that cannot match; a rule without any always runs. Those of
# other rules are derived from their regexes.
ANCHORS = {
    "aws_access_key": (("AKIA",),),
    "aws_secret_key": (("aws",),),
    "api_key_generic": (("api",), ("key",)),
    "github_token": (("_",), ("ghp_", "ghs_")),
    "private_key": (("-",), ("-----BEGIN ",)),
    "password": (("passw", "pwd"),),
    "db_connection": (("://",), ("mongodb+srv:", "postgres:", "mysql:", "redis:", "amqp:", "jdbc:")),
    "jwt_token": ((".eyJ",),),
    "slack_token": (("-",), ("xox",)),
    "google_api": (("AIza",),),
    "stripe_key": (("_",), ("sk_live_",)),
    "azure_connection": (("azure",),),
    "facebook_access_token": (("EAACEdEos0BA",),),
    "twitter_api_key": (("twitter",),),
    "ssh_private_key_id_rsa": (("-",), ("-----BEGIN RSA PRIVATE KEY-----",), ("-----END RSA PRIVATE KEY-----",)),
    "npm_token": (("-",),),
    "docker_hub_token": ((".eyJ",),),
    "sendgrid_api_key": (("SG.",),),
    "mailchimp_api_key": (("-",), ("-us",)),
    "pypi_token": (("-",), ("pypi-",)),
    "openssl_private_key": (("-",), ("-----BEGIN OPENSSH PRIVATE KEY-----",), ("-----END OPENSSH PRIVATE KEY-----",)),
    "cloudinary_creds": (("://",), ("cloudinary://",)),
    "s3_bucket_url": (("://",), ("s3://",), (".amazonaws.com/",)),
}

# A cheaper regex that any match contains, tried after the anchors.
PROBES = {"npm_token": r"-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-"}

#: Rules a set may hold: they become literals of one expression, and a lookup table that is broadcast.
MAX_RULES = 10_000


@dataclass(frozen=True)
class Rule:
    """One detection rule; ``regex`` is None for a rule only the model knows.

    ``anchors`` are groups of literals of which any match holds one each; None derives them from the regex, and () is
    for a rule that runs on every text.
    """

    name: str
    regex: str | None
    keywords: tuple[str, ...]
    description: str
    confidence_boost: Decimal = Decimal("0.0")
    anchors: tuple[tuple[str, ...], ...] | None = None
    probe: str | None = None

    def __post_init__(self) -> None:
        object.__setattr__(self, "keywords", tuple(self.keywords))
        object.__setattr__(self, "confidence_boost", Decimal(str(self.confidence_boost)))
        if self.anchors is None:
            found = literals.anchors(self.regex.removeprefix("(?i)"), self.ignores_case) if self.regex else ()
            object.__setattr__(self, "anchors", found)

    @property
    def ignores_case(self) -> bool:
        return bool(self.regex) and self.regex.startswith("(?i)")

    @property
    def java_regex(self) -> str:
        """The regex with ``.`` stopping at newlines only and Unicode case folding,
        which Java leaves off by default."""
        rest = self.regex.removeprefix("(?i)")
        return "(?d)" + ("(?iu)" if self.ignores_case else "") + rest


class RuleSet:
    """An immutable, ordered set of rules. Names may repeat; ``rule_ord`` is the key: a rule's
    place, or the number that its table gives it.

    More than ``most`` rules are refused, and so are, while a session runs, regexes that Java does not know.
    """

    def __init__(self, rules: tuple[Rule, ...] | list[Rule], ords: list[int] | None = None, most: int = MAX_RULES):
        for rule in rules:
            if not isinstance(rule, Rule):
                raise TypeError(f"expected a Rule, got {type(rule).__name__}")
        if len(rules) > most:
            raise ValueError(f"a rule set holds at most {most} rules")
        self._rules = tuple(rules)
        self.ords = tuple(range(len(rules)) if ords is None else ords)
        if len(set(self.ords)) != len(self._rules):
            raise ValueError("each rule needs a rule_ord of its own")
        self.most = most
        _check_regexes(self._rules)

    def __iter__(self) -> Iterator[Rule]:
        return iter(self._rules)

    def __len__(self) -> int:
        return len(self._rules)

    def __getitem__(self, i: int) -> Rule:
        return self._rules[i]

    def add(self, rule: Rule) -> RuleSet:
        """A new set with ``rule`` last."""
        if not isinstance(rule, Rule):
            raise TypeError(f"expected a Rule, got {type(rule).__name__}")
        return RuleSet((*self._rules, rule), [*self.ords, max(self.ords, default=-1) + 1], self.most)

    def scannable(self) -> list[tuple[int, Rule]]:
        """(rule_ord, rule) of the rules that have a regex."""
        return [(i, rule) for i, rule in zip(self.ords, self._rules) if rule.regex]

    def describe(self) -> str:
        """One ``- name: description`` line per rule, in order."""
        return "\n".join(f"- {rule.name}: {rule.description}" for rule in self._rules)

    def digest(self) -> str:
        """Changes whenever the rules a model is told about change."""
        return hashlib.sha256(self.describe().encode()).hexdigest()

    def to_df(self, spark: SparkSession) -> DataFrame:
        rows = [
            (i, r.name, r.regex, list(r.keywords), r.description, r.confidence_boost)
            for i, r in zip(self.ords, self._rules)
        ]
        return spark.createDataFrame(rows, schemas.RULES)

    def lookup(self, spark: SparkSession) -> DataFrame:
        """The rules with the regex the scan runs, for a broadcast join on rule_ord."""
        return self.to_df(spark).withColumn("regex", java_dialect(F.col("regex")))

    @staticmethod
    def from_df(df: DataFrame, most: int = MAX_RULES) -> RuleSet:
        """Rules from a table with the rules schema, ordered by ``rule_ord``, which they keep.

        Null keywords are none, a null description is empty, a null boost is zero. Raises TypeError when
        a column is missing or of another type, ValueError for a null name or number, or too many rules.
        """
        RuleSet.check_columns(df)
        rows = df.select(*schemas.RULES.names).orderBy("rule_ord").limit(most + 1).collect()
        if any(r.name is None or r.rule_ord is None for r in rows):
            raise ValueError("a rule needs a name and a rule_ord")
        return RuleSet([
            Rule(r.name, r.regex, tuple(k for k in r.keywords or () if k is not None), r.description or "",
                 r.confidence_boost or Decimal("0.0"), *builtin_hints(r.name, r.regex))
            for r in rows
        ], [r.rule_ord for r in rows], most)

    @staticmethod
    def check_columns(df: DataFrame) -> None:
        """Raises TypeError unless the table has the rules schema's columns."""
        have = {f.name: f.dataType for f in df.schema.fields}
        for field in schemas.RULES.fields:
            got = have.get(field.name)
            if got is None or got.typeName() != field.dataType.typeName():
                raise TypeError(f"rules column {field.name}: expected {field.dataType}, got {got}")


def _check_regexes(rules: tuple[Rule, ...]) -> None:
    """Raises ValueError for a regex that Spark can't compile; built-in ones are known to be right.

    All new regexes are compiled by one query over a local table; only when it fails, halves of them tell which is wrong.
    """
    spark = SparkSession.getActiveSession()
    new = {r.java_regex: r for r in rules if r.regex and r.regex not in _COMPILED}
    if not spark or not new:
        return

    def wrong(regexes: list[str]) -> str | None:
        rows = spark.createDataFrame([(r,) for r in regexes], "regex string")
        try:
            rows.select(F.regexp_like(F.lit(""), F.col("regex")).alias("ok")).agg(F.count("ok")).collect()
            return None
        except Exception:
            if len(regexes) == 1:
                return regexes[0]
            half = len(regexes) // 2
            return wrong(regexes[:half]) or wrong(regexes[half:])

    bad = wrong(list(new))
    if bad:
        raise ValueError(f"rule {new[bad].name}: {new[bad].regex!r} is no regex that Spark knows")
    _COMPILED.update(r.regex for r in new.values())


_COMPILED: set[str] = {row[1] for row in BUILT_IN}


def java_dialect(regex: Column) -> Column:
    """Column form of :attr:`Rule.java_regex`."""
    return F.concat(F.lit("(?d)"), F.regexp_replace(regex, r"^\(\?i\)", "(?iu)"))


def builtin_hints(name: str, regex: str | None) -> tuple:
    """Anchors and probe of a built-in rule, if this is one unchanged."""
    known = any((name, regex) == row[:2] for row in BUILT_IN)
    return (ANCHORS[name], PROBES.get(name)) if known else (None, None)


def default_rules() -> RuleSet:
    return RuleSet([
        Rule(name, regex, tuple(keywords), description, Decimal(boost), *builtin_hints(name, regex))
        for name, regex, keywords, description, boost in BUILT_IN
    ])
