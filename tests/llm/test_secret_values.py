"""Values are masked whole: between quotes to the closing one, without quotes to white space; sentences stay. No text here is made by the rule that the forest learns from."""

from gristmill.llm import secrets

SECRET = {
    'password: "pa,ss w0rd#24!x"': "pa,ss w0rd#24!x",
    'passphrase = "correct horse battery staple"': "correct horse battery staple",
    "DB_PASSWORD=ab#1,cd9K!xYz": "ab#1,cd9K!xYz",
    "api_key: 'q8;Zt<1 >x,42pLw'": "q8;Zt<1 >x,42pLw",
    r'auth_token = "k9\"Lw,4 tZ7\"q"': r"k9\"Lw,4 tZ7\"q",
    "token=Zx81,kQ;p27Tw, and more": "Zx81,kQ;p27Tw",
    "redis://:" + "k3J9x" * 60 + "@cache.host/0": ":" + "k3J9x" * 60,
    '{"pwd":"T4,w x!9Rk", "user":"jo"}': "T4,w x!9Rk",
    "<b>password: h7Gt4!kQz</b>": "h7Gt4!kQz",
    # No closing quote on the line: what stands before white space.
    'password = "h7Gt4!kQz\nnext line"': "h7Gt4!kQz",
}
CLEAN = [
    'password: "Enter your new password here"',
    'They kept a secret: "she never knew what he was up to, not at all"',
    'token: "the end of a line"',
    "password: ''",
    'secret = ""',
    "the signature: please sign here, and here",
]


def test_whole_values(spark):
    rows = [(i, t) for i, t in enumerate([*SECRET, *CLEAN])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in secrets.mask_secrets(df).collect()}
    for i, (text, value) in enumerate(SECRET.items()):
        assert got[i] == text.replace(value, secrets.MASK), (text, got[i])
    for i, text in enumerate(CLEAN, len(SECRET)):
        assert got[i] == text


def test_scan_and_mask_agree(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(SECRET)], "doc_id long, text string")
    texts = [*SECRET]
    for r in secrets.scan(df).collect():
        assert texts[r.doc_id][r.start : r.start + len(r.candidate)] == r.candidate


def test_open_quotes_without_end(spark):
    """Many opened quotes, and a line of half a megabyte: each is read once."""
    text = "password: \"abc 'x " * 20_000 + "secret='" + "word " * 100_000
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert secrets.mask_secrets(df).count() == 1 and secrets.scan(df).count() > 0
