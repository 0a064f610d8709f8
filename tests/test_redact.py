import pytest

from corpusmill.operators import redact

GOLDEN = [
    ("-----BEGIN RSA PRIVATE KEY-----\nabc\n-----END RSA PRIVATE KEY----- and", "<private_key> and"),
    ("-----BEGIN PRIVATE KEY-----\ncut off", "<private_key>"),
    ("use ghp_" + "a1" * 12 + " now", "use <provider_token> now"),
    ("https://me:pw@site.example/x", "https://<url_login>@site.example/x"),
    ("Authorization: Bearer abcdef123456", "Authorization: Bearer <bearer_token>"),
    ("password = 'hunter22' and password: <secret>", "password = '<password>' and password: <secret>"),
    ("run --password s3cr3t x", "run --password <password_option> x"),
    ("api_key: zz-99-xx", "api_key: <secret>"),
    ("密码是abc123。", "密码是<secret_zh>。"),
    ("nic 0a:1b:2c:3d:4e:5f up", "nic <mac> up"),
    ("nic 0a-1b-2c-3d-4e-5f up", "nic <mac> up"),
    ("at fe80::1ff:fe23:4567:890a and x[1, ::2] y[::3]", "at <ipv6> and x[1, ::2] y[::3]"),
    ("at 10.1.2.3 but pkg==1.2.3.4 and 1.2.3.4.5", "at <ipv4> but pkg==1.2.3.4 and 1.2.3.4.5"),
    ("mail a.b@lab.example today", "mail <email> today"),
    ("ssh root@box7 now", "ssh <login_at_host> now"),
    ("in /home/ana/x.txt or", "in <home_path> or"),
    (r"C:\Users\ana\x", r"C:\Users\<windows_home>\x"),
    ("see ~ana/x and ~/x", "see <tilde_home>/x and ~/x"),
    ("user: ana_b and user: $USER", "user: <login> and user: $USER"),
    ("x --user ana", "x --user <login_option>"),
    ("docker exec -it web_1 sh", "docker exec -it <container_command> sh"),
    ("run --name web7 img", "run --name <container_option> img"),
    ("container: web-7", "container: <container>"),
    ("ping db.corp soon", "ping <private_domain> soon"),
    ("on node-12 it", "on <numbered_host> it"),
    ("on machine 12 it", "on machine <machine> it"),
    ("hostname=alpha-9", "hostname=<host>"),
    ("by ab12345678.", "by <staff_number>."),
    ("see QX-123 or", "see <ticket> or"),
    ("k " + "xB3" * 12 + " and " + "0af" * 12, "k <random_token> and " + "0af" * 12),
    ("plain words, 中文 and 12 numbers", "plain words, 中文 and 12 numbers"),
    ("", ""),
    (None, None),
]


@pytest.fixture(scope="module")
def done(spark):
    df = spark.createDataFrame([(i, t, "x") for i, (t, _) in enumerate(GOLDEN)], "n int, text string, findings string")
    return {r["n"]: r for r in redact.marked(df.drop("findings"), "text").collect()}


@pytest.mark.parametrize("n", range(len(GOLDEN)))
def test_kinds(done, n):
    text, want = GOLDEN[n]
    assert done[n]["redacted"] == want
    assert len(done[n]["findings"]) == (0 if text == want else 1)


def test_every_kind_has_a_case():
    assert all(any(f"<{k}>" in (w or "") for _, w in GOLDEN) for k in redact.KINDS)


def test_allowed_values_are_claimed_but_no_findings(spark):
    df = spark.createDataFrame([("a", "10.1.2.3 and 10.1.2.4")], "id string, text string")
    assert [tuple(r)[:3] for r in redact.scan(df, "id", "text", allow=r"10\.1\.2\.3").collect()] == [("a", "ipv4", 0)]


def test_trees(spark):
    df = spark.createDataFrame([("a", '{"a@lab.example": {"x": "10.1.2.3"}, "n": 1}'), ("b", "{broken"), ("c", None)], "id string, doc string")
    got = sorted((r["key"], r["pointer"], r["part"], r["kind"]) for r in redact.scan_tree(df, "id", "doc").collect())
    assert got == [("a", "/a@lab.example", "key", "email"), ("a", "/a@lab.example", "value", "ipv4")]
