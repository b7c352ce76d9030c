from datetime import datetime

from pyspark.sql import functions as F

from quarrystone.extract import accounts, files, logs, processes


def lines(spark, text, path="/var/log/x"):
    return spark.createDataFrame([(path, i, x) for i, x in enumerate(text, 1)], "path string, line_no long, line string").repartition(3)


def table(df, *columns):
    order = ["line_no"] if "line_no" in df.columns else df.columns[:1]
    return [tuple(r[c] for c in columns) for r in df.orderBy(*order).collect()]


def test_line_shapes(spark):
    text = {
        "Mar 24 15:47:28 web01 sshd[12]: hello: there": ("Mar 24 15:47:28", "web01", "sshd", "12", "hello: there"),
        "2026-03-24T15:47:28+00:00 web01 kernel: x": ("2026-03-24T15:47:28+00:00", "web01", "kernel", "", "x"),
        "Mar 24 15:47:28 proc: msg": ("Mar 24 15:47:28", "", "proc", "", "msg"),
        '1.2.3.4 - bob [24/Mar/2026:15:47:28 +0000] "GET / HTTP/1.1" 200 5': ("24/Mar/2026:15:47:28 +0000", "1.2.3.4", "http", "", "GET / HTTP/1.1 -> 200 (5 bytes) user=bob"),
        "E [24/Mar/2026:19:16:30 -0400] bad": ("24/Mar/2026:19:16:30 -0400", "", "error", "", "bad"),
        "update-alternatives 2026-03-24 15:48:15: run with --x": ("2026-03-24 15:48:15", "", "update-alternatives", "", "run with --x"),
        "Log started: 2026-03-24  15:48:35": ("2026-03-24  15:48:35", "", "", "", "Log started"),
        "2026-03-24 15:48:35 install a": ("2026-03-24 15:48:35", "", "", "", "install a"),
        "nothing here  ": ("", "", "", "", "nothing here"),
    }
    got = lines(spark, text).withColumn("s", logs.split_line(F.col("line"))).orderBy("line_no").collect()
    assert [tuple(r["s"]) for r in got] == list(text.values())


AUTH = [
    "Mar 24 10:00:00 h sshd[1]: Failed password for invalid user bob from 1.2.3.4 port 22 ssh2",
    "Mar 24 10:00:01 h sshd[1]: Accepted publickey for ann from 5.6.7.8: port 51 ssh2",
    "Mar 24 10:00:02 h sudo:   ann : TTY=pts/0 ; PWD=/home/ann ; USER=root ; COMMAND=/bin/ls -l",
    "Mar 24 10:00:03 h cronlike:   ann : TTY=pts/0 ; PWD=/ ; USER=root ; COMMAND=/bin/x",
    "Mar 24 10:00:04 h useradd[9]: new user: name=eve, UID=1001",
    "Mar 24 10:00:05 h su[3]: FAILED su (to root) ann on pts/0",
    "Mar 24 10:00:06 h sshd[1]: Connection closed by authenticating user bob 1.2.3.4 port 22 [preauth]",
    "Mar 24 10:00:07 h login[2]: pam_unix(login:auth): authentication failure; logname= uid=0 rhost=9.9.9.9 user=zed",
    "no header",
]


def test_auth_log_and_failed_logins(spark):
    collected = F.lit(datetime(2026, 3, 25)).cast("timestamp")
    auth = logs.auth_log(lines(spark, AUTH, "/var/log/auth.log"), collected)
    assert table(auth, "event", "event_class", "user", "target_user", "source_ip", "result") == [
        ("failed password", "auth", "bob", "", "1.2.3.4", "failure"), ("accepted login", "auth", "ann", "", "5.6.7.8", "success"), ("sudo command", "priv", "ann", "root", "", "success"), ("", "", "", "", "", ""),
        ("account created", "priv", "", "eve", "", "success"), ("su", "priv", "ann", "root", "", "failure"), ("connection closed", "auth", "bob", "", "1.2.3.4", "failure" if "fail" in AUTH[6].lower() else "success"), ("authentication failure", "auth", "zed", "", "9.9.9.9", "failure"),
    ]
    first = auth.orderBy("line_no").first()
    assert first["timestamp_utc"] == datetime(2026, 3, 24, 10) and first["port"] == "22" and first["pid"] == "1"
    assert table(auth.where("event = 'sudo command'"), "tty", "pwd", "command") == [("pts/0", "/home/ann", "/bin/ls -l")]
    assert table(logs.failed_logins(auth), "kind", "user", "source_ip") == [("bad password", "bob", "1.2.3.4"), ("su failure", "root", ""), ("aborted before authenticating", "bob", "1.2.3.4"), ("pam authentication failure", "", "")]


def test_web_log(spark):
    text = [
        '1.2.3.4 - - [24/Mar/2026:15:47:28 +0000] "GET /a?b HTTP/1.1" 404 12 "-" "curl"',
        '2026/03/24 15:47:28 [error] 1#1: *1 open() failed, client: 5.6.7.8, request: "POST /x HTTP/1.1", referrer: "http://r/"',
        "[Tue Mar 24 15:47:28.123456 2026] [core:error] [pid 7] (20023)bad: [client 9.9.9.9:5] AH00127: Cannot map GET /y HTTP/1.1 to file",
        "some startup text AH00558: no name",
        "",
    ]
    got = table(logs.web_log(lines(spark, text, "/var/log/nginx/access.log")), "kind", "client_ip", "method", "resource", "status", "level", "code", "server")
    assert got == [("access", "1.2.3.4", "GET", "/a?b", "404", "", "", "nginx"), ("error", "5.6.7.8", "POST", "/x", "", "error", "", "nginx"), ("error", "9.9.9.9", "GET", "/y", "", "error", "AH00127", "nginx"), ("access", "", "", "", "", "", "AH00558", "nginx")]
    both = lines(spark, text, "/a").unionByName(lines(spark, ["db started", "x"], "/b"))
    assert [r["path"] for r in logs.web_files(both).collect()] == ["/a"]


def test_shell_history(spark):
    homes = spark.createDataFrame([("root", "/root"), ("ann", "/home/ann"), ("deep", "/home/ann/deep/")], "user string, home string")
    bash = lines(spark, ["plain", "#1774367248", "", "first", "second", "#1774367248", "#1774367300", "third"], "/home/ann/.bash_history")
    zsh = lines(spark, [": 1774367248:0;ls", "plain"], "/home/ann/deep/.zsh_history")
    fish = lines(spark, ["- cmd: a", "  when: 1774367248", "- cmd: lost", "- cmd: b"], "/root/.local/share/fish/fish_history")
    out = logs.shell_history(bash.unionByName(zsh).unionByName(fish), homes)
    got = {(r["user"], r["command"]): r["timestamp_utc"].strftime("%H:%M:%S") if r["timestamp_utc"] else None for r in out.collect()}
    assert got == {("ann", "plain"): None, ("ann", "first"): "15:47:28", ("ann", "second"): None, ("ann", "third"): "15:48:20", ("deep", "ls"): "15:47:28", ("deep", "plain"): None, ("root", "a"): "15:47:28", ("root", "b"): None}


def test_audit_log(spark):
    text = ["type=USER_CMD msg=audit(1774367248.123:77): pid=5 uid=0 auid=1000 msg='cwd=\"/root\" cmd=6C73202D6C terminal=pts/0 res=success'", "type=SYSCALL msg=audit(1774367249.0:78): syscall=59 success=yes comm=\"ls\" exe=\"/bin/ls\" key=(null)", "junk"]
    got = table(logs.audit_log(lines(spark, text)), "event_id", "type", "pid", "cwd", "message", "terminal", "success", "exe")
    assert got[0] == ("77", "USER_CMD", "5", "/root", "ls -l", "pts/0", "success", "") and got[1][0::6] == ("78", "yes") and got[1][7] == "/bin/ls"


def test_package_history(spark):
    text = ["2026-03-24 15:48:35 install pkg:amd64 <none> 1.0", "update-alternatives 2026-03-24 15:48:15: run with x", "odd"]
    assert table(logs.package_lines(lines(spark, text)), "action", "package", "version") == [("install", "pkg:amd64", "1.0"), ("run", "", ""), ("", "", "")]
    block = ["Start-Date: 2026-03-24  15:48:35", "Commandline: apt install nmap", "Install: nmap:amd64 (7.9, automatic), lib:amd64 (1, 2)", "End-Date: 2026-03-24  15:48:40", "", "Start-Date: 2026-03-25  01:00:00", "Remove: x:all (3)"]
    got = sorted(tuple(r) for r in logs.package_blocks(lines(spark, block)).select("action", "package", "version", "commandline").collect())
    assert got == [("install", "lib:amd64", "1, 2", "apt install nmap"), ("install", "nmap:amd64", "7.9, automatic", "apt install nmap"), ("remove", "x:all", "3", "")]


def test_package_lines_are_matched_once(spark):
    text = ["2026-03-24 15:48:35 status", " 2026-03-24  15:48:35\tremove  a:all  1.0 ", "2026-03-24 99:48:35 install b 1 2", "x 2026-03-24 15:48:15:", "2026-03-24 2026-03-25 10:00:00: y  z"]
    df = logs.package_lines(lines(spark, text))
    got = [(str(r["timestamp_utc"]), r["timestamp"], r["action"], r["package"], r["version"], r["detail"]) for r in df.orderBy("line_no").collect()]
    assert got == [
        ("2026-03-24 15:48:35", "2026-03-24 15:48:35", "status", "", "", ""), ("2026-03-24 15:48:35", "2026-03-24  15:48:35", "remove", "a:all", "1.0", "a:all  1.0"),
        ("None", "2026-03-24 99:48:35", "install", "b", "2", "b 1 2"), ("2026-03-24 15:48:15", "2026-03-24 15:48:15", "", "", "", ""), ("2026-03-25 10:00:00", "2026-03-25 10:00:00", "y", "", "", "y  z"),
    ]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(logs.PACKAGE_TOOL) <= 3 and plan.count(logs.PACKAGE_LINE) <= 4


BODY = [
    "0|/usr/sbin/sshd|1|-rwxr-xr-x|0|0|10|1700000101|1700000101|1600000000|0",
    "0|/usr/lib/libc.so.7|2|-rwxr-xr-x|0|0|10|1500000001|1500000001|1600000000|1700000000",
    "0|/tmp/.x/pay|load|3|-rwxr-xr-x|0|0|10|1500000000|1500000000|1700000007|1700000005",
    "0|/var/www/html/shell.php|4|-rw-r--r--|0|0|10|1700000001|0|1700000001|0",
    "0|/etc/quiet|5|-rw-r--r--|0|0|10|1690000001|1690000002|1690000003|1690000002",
    "0|/tmp/dir|6|drwxrwxrwt|0|0|10|1500000000|1500000000|1700000007|1700000005",
]


def test_bodyfile_and_timestomp(spark):
    body = files.bodyfile(lines(spark, BODY))
    assert "/tmp/.x/pay|load" in {r["path"] for r in body.collect()}
    rules = {}
    for r in files.timestomp(body, 1_699_900_000).collect():
        rules.setdefault(r["rule"], set()).add(r["path"])
    assert rules == {"mtime_ahead": {"/usr/sbin/sshd"}, "pre_creation": {"/usr/lib/libc.so.7"}, "new_file_old_mtime": {"/usr/lib/libc.so.7", "/tmp/.x/pay|load"}, "minute_aligned": {"/tmp/.x/pay|load"}, "stamp_missing": {"/var/www/html/shell.php"}}
    assert "new_file_old_mtime" not in {r["rule"] for r in files.timestomp(body, None).collect()}


def test_hashes_and_unparsed(spark):
    h = files.file_hashes(lines(spark, [f"{'a' * 32}  /bin/x", f"{'b' * 64} */bin/x", "junk", f"{'a' * 32}  /bin/y"]))
    assert sorted((r["path"], r["md5"], r["sha256"]) for r in h.collect()) == [("/bin/x", "a" * 32, "b" * 64), ("/bin/y", "a" * 32, None)]
    assert files.same_content(h).first()["names"] == ["x", "y"]
    f = spark.createDataFrame([("/a", 0), ("/b.png", 5), ("/c", 9)], "path string, size long")
    c = spark.createDataFrame([("/c", "X")], "path string, table string")
    assert sorted((r["path"], r["reason"]) for r in files.unparsed(f, c).collect()) == [("/a", "empty"), ("/b.png", "media")]


def test_accounts(spark):
    p = accounts.passwd(lines(spark, ["root:x:0:0:root:/root:/bin/bash", "toor:x:0:0::/:/bin/sh", "daemon:x:1:1::/:/usr/sbin/nologin", "ann:x:1000:1000:Ann:/home/ann:/bin/zsh", "#c:x", ""]))
    s = accounts.shadow(lines(spark, ["root:$6$x:19000:0:99999:7:::", "toor::19000::::::", "ann:!:19000::::::"]))
    g = accounts.groups(lines(spark, ["root:x:0:", "sudo:x:27:ann,bob", "ann:x:1000:"]))
    u = accounts.users(p, s, g, {"failed_logins": spark.createDataFrame([("ann",), ("ann",)], "username string")})
    got = {r["username"]: r for r in u.collect()}
    assert got["ann"]["all_groups"] == "ann, sudo" and got["ann"]["privileged_groups"] == "sudo" and got["ann"]["failed_logins"] == 2 and got["root"]["password_status"] == "set"
    titles = {(r["title"], r["username"]) for r in accounts.account_findings(u, p.where("username <> 'ann'")).collect()}
    assert ("Non-root account(s) with uid 0", "toor") in titles and ("Account(s) with an empty password hash", "toor") in titles and ("Account(s) present in /etc/passwd but not in the backup copy", "ann") in titles
    c = accounts.cron(lines(spark, ["# c", "SHELL=/bin/sh", "*/5 * * * * root /usr/bin/x -a", "@daily root y"], "/etc/cron.d/z"))
    assert table(c, "kind", "schedule", "run_as", "command") == [("environment", "", "", "SHELL=/bin/sh"), ("crontab", "*/5 * * * *", "root", "/usr/bin/x -a"), ("crontab", "@daily", "root", "y")]


def test_processes_and_sockets(spark):
    ps = processes.ps_lines(lines(spark, ["root 1 0 /sbin/init", "ann 50 1 /tmp/evil -x"]))
    extra = spark.createDataFrame([(50, "/tmp/evil (deleted)", "1"), (77, "/home/a/b", "50")], "pid int, exe string, ppid string")
    m = {r["pid"]: r for r in processes.process_master({"ps": ps, "proc": extra}).collect()}
    assert m[50]["flags"] == "deleted, tmp exe" and m[50]["parent"] == "/sbin/init" and m[50]["sources"] == "proc, ps" and m[77]["parent"] == "/tmp/evil -x"
    net = processes.proc_net(lines(spark, ["sl local rem", "0: 0100007F:1F90 00000000:0000 0A 0:0 0:0 0 1000 0 4242 1", "1: 0100007F:0016 0200007F:9C40 01 0:0 0:0 0 0 0 4243 1"], "/proc/net/tcp"))
    ss = processes.ss_lines(lines(spark, ['tcp LISTEN 0 128 127.0.0.1:8080 0.0.0.0:* users:(("web",pid=9,fd=3))', "tcp ESTAB 0 0 10.0.0.1:22 8.8.8.8:4444"]))
    assert [r["local_port"] for r in processes.unlisted(net, ss).collect()] == [22]
    owned = processes.attributed(net, spark.createDataFrame([("4242", 9)], "inode string, pid int"), spark.createDataFrame([("127.0.0.1", 22, 5)], "local_addr string, local_port int, pid int"))
    assert sorted((r["pid"], r["attributed_by"]) for r in owned.collect()) == [(5, "endpoint"), (9, "inode")]
    found = {(r["severity"], r["title"]) for r in processes.socket_findings(ss).collect()}
    assert ("CRITICAL", "established connection(s) with no owning process") in found and ("MEDIUM", "connection(s) to non-RFC1918 addresses") in found and ("HIGH", "Socket(s) on ports associated with implants") in found


def test_wordings_of_the_authorization_log(spark):
    said = {
        "pkexec[3]: kim: Executing command [USER=root] [TTY=/dev/pts/1] [CWD=/srv] [COMMAND=/usr/sbin/fdisk -l]": ("pkexec", "kim", "root", "", "/usr/sbin/fdisk -l"),
        "gpasswd[4]: user lee added by root to group docker": ("group membership change", "root", "lee", "", ""),
        "usermod[4]: add 'lee' to shadow group 'wheel'": ("group membership change", "", "lee", "", ""),
        "userdel[5]: delete user 'lee'": ("account deleted", "", "lee", "", ""),
        "sshd[6]: Disconnected from user kim 192.0.2.7 port 40112": ("connection closed", "kim", "", "192.0.2.7", ""),
        "sshd[6]: Received disconnect from 192.0.2.7 port 40112:11: bye [preauth]": ("connection closed", "", "", "192.0.2.7", ""),
        "sshd[7]: error: maximum authentication attempts exceeded for invalid user pi from 198.51.100.4 port 5 ssh2": ("max auth attempts", "pi", "", "198.51.100.4", ""),
        "sshd[8]: Invalid user  from 198.51.100.5 port 6": ("invalid user", "", "", "198.51.100.5", ""),
        "sudo:   kim : 3 incorrect password attempts ; TTY=pts/2 ; PWD=/ ; USER=root ; COMMAND=/bin/sh": ("sudo denied", "kim", "", "", ""),
        "sudo:   kim : TTY=pts/2 ; PWD=/srv ; USER=root ; GROUP=adm ; ENV=A=1 B=2 ; COMMAND=/bin/ls /": ("sudo command", "kim", "root", "", "/bin/ls /"),
        "sudo:   kim : a password is required": ("sudo denied", "kim", "", "", ""),
        "passwd[9]: pam_unix(passwd:chauthtok): password changed for kim": ("password changed", "", "kim", "", ""),
        "systemd-logind[1]: Removed session 4.": ("session removed", "", "", "", ""),
    }
    auth = logs.auth_log(lines(spark, [f"2026-05-06T07:08:09Z host1 {x}" for x in said], "/var/log/secure"))
    assert table(auth, "event", "user", "target_user", "source_ip", "command") == list(said.values())
    kinds = table(logs.failed_logins(auth), "line_no", "kind", "user", "source_ip", "detail")
    assert kinds == [(6, "aborted before authenticating", "", "192.0.2.7", ""), (7, "too many attempts", "pi", "198.51.100.4", ""), (8, "unknown account", "", "198.51.100.5", ""), (9, "sudo password failure", "kim", "", "3 incorrect password attempts")]
