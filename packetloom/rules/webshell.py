"""Fixed values of the web-shell analysis: patterns, weights and word lists, in their natural order."""

# Words that make a decoded text meaningful.
MEANINGFUL = [
    "cd ", "ls", "dir", "cat ", "echo", "whoami", "pwd", "type ", "net ", "ipconfig", "ifconfig", "ping ", "curl ", "wget ",
    "chmod", "chown", "mkdir", "rmdir", "cp ", "mv ", "rm ", "ps ", "kill", "top", "df ", "du ", "grep", "find ",
    "<?php", "<%", "function", "class ", "import ", "require", "include", "eval", "exec", "system", "shell_exec", "passthru",
    "select", "insert", "update", "delete", "from", "where", "union", "drop", "create", "alter", "truncate",
    "/", "\\", ".php", ".asp", ".jsp", ".txt", ".log", ".conf", "/etc/", "/var/", "/tmp/", "c:\\", "d:\\",
    "cmd", "shell", "popen", "proc_open",
]
# Words of decrypted code.
DECRYPTED = ["eval", "exec", "system", "shell", "cmd", "base64", "php", "class", "function", "return", "echo", "print", "<?", "?>", "error_reporting", "ini_set", "assert", "preg_replace", "file_get_contents", "file_put_contents", "fopen", "fwrite"]
# Lengths of random prefixes before base64.
PREFIXES = [0, 2, 3, 4, 5, 6, 8, 10]
# What a decoded text is for, the first pattern that matches (on the lower-cased text).
PURPOSES = [
    (r"^\s*cd\s+['\"]?[/\\]", "Command (cd)"),
    (r"\b(whoami|id|pwd|hostname)\b", "Command (Info Gathering)"),
    (r"\b(ls|dir|find|type|cat|head|tail)\s", "Command (File Listing)"),
    (r"\b(net\s+user|ipconfig|ifconfig|netstat)\b", "Command (Network)"),
    (r"echo\s*\[s\]|echo\s*\[e\]", "Command (AntSword Marker)"),
    (r"\b(rm|del|rmdir|mkdir|mv|cp|copy)\s", "Command (File Operation)"),
    (r"\b(wget|curl|nc|ncat)\s", "Command (Download/Connect)"),
    (r"\b(chmod|chown|chgrp)\s", "Command (Permission)"),
]
PURPOSES_AFTER_PATH = [
    (r"<\?php|\$_|function\s+\w+\s*\(|class\s+\w+", "PHP Code"),
    (r"<%|response\.write|request\.form|server\.mappath", "ASP Code"),
    (r"<%@|request\.getparameter|runtime\.exec|processbuilder", "JSP Code"),
]
# Parameter names that are none.
BAD_NAMES = [r"^[\s;\"'(){}<>=]+$", "content-disposition", "content-type", "boundary="]
# User agents and the JDK's accept headers.
BEHINDER_AGENTS = ["Mozilla/5.0 (compatible; MSIE 9.0; Windows NT 6.1; Win64; x64; Trident/5.0)", "Mozilla/4.0 (compatible; MSIE 8.0;", "Mozilla/5.0 (Linux; U; Android 2.2;"]
JDK_ACCEPT = [r"text/html.*image/gif.*image/jpeg.*\*.*q=\.2", r"\*;\s*q=\.2.*\*/\*;\s*q=\.2", r"image/gif.*image/jpeg.*\*;"]
# Fields of a JSON answer that may hold a key.
KEY_FIELDS = ["key", "k", "secret", "token", "data"]
# Pairs of markers of malicious files (the second may be absent), what they are, extension, category; the first pair wins.
MALICIOUS = [
    ("<?php", "eval(", "PHP eval webshell", "php", "webshell"),
    ("<?php", "assert(", "PHP assert webshell", "php", "webshell"),
    ("<?php", "system(", "PHP system webshell", "php", "webshell"),
    ("<?php", "exec(", "PHP exec webshell", "php", "webshell"),
    ("<?php", "shell_exec(", "PHP shell_exec webshell", "php", "webshell"),
    ("<?php", "passthru(", "PHP passthru webshell", "php", "webshell"),
    ("<?php", "popen(", "PHP popen webshell", "php", "webshell"),
    ("<?php", "proc_open(", "PHP proc_open webshell", "php", "webshell"),
    ("<?php", "base64_decode(", "PHP base64 webshell", "php", "webshell"),
    ("<?php", "gzinflate(", "PHP gzinflate webshell", "php", "webshell"),
    ("<?php", "str_rot13(", "PHP rot13 webshell", "php", "webshell"),
    ("<?php", "$_post[", "PHP POST webshell", "php", "webshell"),
    ("<?php", "$_get[", "PHP GET webshell", "php", "webshell"),
    ("<?php", "$_request[", "PHP REQUEST webshell", "php", "webshell"),
    ("<?", "@ini_set", "AntSword/Caidao webshell", "php", "webshell"),
    ("<?", "@eval($_", "One-liner webshell", "php", "webshell"),
    ("powershell", "-encodedcommand", "PowerShell encoded command", "ps1", "script"),
    ("powershell", "-nop", "PowerShell no profile", "ps1", "script"),
    ("powershell", "downloadstring", "PowerShell download", "ps1", "script"),
    ("powershell", "invoke-expression", "PowerShell IEX", "ps1", "script"),
    ("[system.convert]::frombase64", "", "PowerShell base64", "ps1", "script"),
    ("new-object system.net.webclient", "", "PowerShell WebClient", "ps1", "script"),
    ("wscript.shell", "run", "VBScript shell run", "vbs", "script"),
    ("wscript.shell", "exec", "VBScript shell exec", "vbs", "script"),
    ("scripting.filesystemobject", "", "VBScript file operation", "vbs", "script"),
    ("adodb.stream", "", "VBScript stream", "vbs", "script"),
]
SHELL_DANGERS = ["curl ", "wget ", "/dev/tcp/", "nc ", "netcat ", "bash -i", "/bin/sh", "python -c", "perl -e", "rm -rf", "chmod 777", "base64 -d"]
MALICIOUS_BATCH = [
    ("@echo off", "powershell", "Batch with PowerShell", "bat", "script"),
    ("@echo off", "certutil", "Batch with certutil", "bat", "script"),
    ("@echo off", "bitsadmin", "Batch with bitsadmin", "bat", "script"),
    ("cmd /c", "powershell", "CMD with PowerShell", "bat", "script"),
]
MALICIOUS_JS = [
    ("eval(", "unescape(", "JavaScript eval+unescape", "js", "script"),
    ("eval(", "fromcharcode", "JavaScript eval+charcode", "js", "script"),
    ("document.write(unescape", "", "JavaScript document.write", "js", "script"),
    ("activexobject", "wscript.shell", "JavaScript ActiveX shell", "js", "script"),
]
# The statistical analysis' thresholds with their weights, highest first.
STAT_ENTROPY = [(6.5, 70, "critical"), (5.5, 50, "high"), (4.5, 30, "medium")]
STAT_SPECIAL = [(0.5, 60, "critical"), (0.35, 45, "high"), (0.25, 25, "medium")]
STAT_NON_PRINTABLE = [(0.3, 45), (0.1, 25)]
# What a response's type and path must be for a real download.
DOWNLOAD_TYPES_NOT = ["text/html", "text/css", "text/javascript", "application/javascript", "application/json", "application/xml", "application/x-www-form-urlencoded", "text/plain"]
DOWNLOAD_TYPES = [
    "application/zip", "application/x-zip-compressed", "application/x-rar-compressed", "application/x-7z-compressed", "application/gzip", "application/x-gzip", "application/x-tar",
    "application/octet-stream", "application/pdf", "application/x-msdownload", "application/x-executable", "application/x-php", "application/x-httpd-php",
    "application/vnd.ms-cab-compressed", "application/x-shockwave-flash", "application/java-archive", "image/png", "image/jpeg", "image/gif",
]
API_PATHS = ["/api/", "/v1/", "/v2/", "/v3/", "/login", "/logout", "/auth", "/oauth", "/user", "/admin", "/dashboard", "/ajax/", "/json/", "/xml/", "/status", "/health", "/ping", "/session", "/token", "/refresh", ".json", ".xml"]
# Kinds of extensions, for disguise and helpers.
IMAGES = ["jpg", "jpeg", "png", "gif", "bmp", "ico", "svg", "webp"]
DOCUMENTS = ["doc", "docx", "pdf", "xls", "xlsx", "ppt", "pptx", "txt"]
EXECUTABLES = ["exe", "dll", "elf", "so", "class", "jar"]
SCRIPTS = ["php", "jsp", "asp", "aspx", "py", "sh", "bat", "ps1", "vbs", "js"]
ARCHIVES = ["zip", "rar", "7z", "tar", "gz", "bz2", "cab"]
# Extensions worth keeping, API words in names, markers of pages, errors and JSON answers.
VALUABLE = [".zip", ".rar", ".7z", ".tar", ".gz", ".bz2", ".exe", ".dll", ".so", ".elf", ".bin", ".php", ".jsp", ".asp", ".aspx", ".py", ".sh", ".bat", ".ps1", ".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx", ".sql", ".db", ".sqlite", ".mdb", ".png", ".jpg", ".jpeg", ".gif", ".bmp", ".txt", ".log", ".cfg", ".conf", ".ini"]
SMALL_IMAGES = [".png", ".jpg", ".jpeg", ".gif", ".bmp"]
SMALL_TEXTS = [".txt", ".log", ".cfg", ".conf", ".ini"]
API_NAMES = ["login", "logout", "auth", "api", "json", "xml", "status", "ajax"]
API_NAMES_KEEP = [".zip", ".rar", ".7z", ".exe", ".pdf", ".doc", ".xls"]
HTML_MARKERS = ["<!doctype", "<html", "<head>", "<body>", "<title>"]
ERROR_MARKERS = ["404", "not found", "forbidden", "error", "access denied"]
JSON_MARKERS = ['{"', "[{", '"status":', '"error":', '"data":', '"message":']
SCRIPT_MARKERS = [("<?php", "PHP script"), ("<%@", "JSP/ASP script"), ("#!/", "Shell script"), ("import ", "Python script"), ("function ", "JavaScript/PHP function"), ("class ", "Class definition")]
# Signatures of the extraction service in hexadecimal (matches run on hex text), longest first by rule: extension, type, category, description.
SERVICE_MAGIC = [
    ("504B0304", "zip", "application/zip", "archive", "ZIP Archive"),
    ("504B0506", "zip", "application/zip", "archive", "ZIP Archive (empty)"),
    ("526172211A07", "rar", "application/x-rar-compressed", "archive", "RAR Archive"),
    ("377ABCAF271C", "7z", "application/x-7z-compressed", "archive", "7-Zip Archive"),
    ("1F8B08", "gz", "application/gzip", "archive", "GZIP Archive"),
    ("425A68", "bz2", "application/x-bzip2", "archive", "BZIP2 Archive"),
    ("4D534346", "cab", "application/vnd.ms-cab-compressed", "archive", "Windows Cabinet"),
    ("4D5A", "exe", "application/x-msdownload", "executable", "Windows Executable"),
    ("7F454C46", "elf", "application/x-executable", "executable", "Linux ELF"),
    ("CAFEBABE", "class", "application/java-vm", "executable", "Java Class"),
    ("25504446", "pdf", "application/pdf", "document", "PDF Document"),
    ("D0CF11E0A1B11AE1", "doc", "application/msword", "document", "MS Office Document"),
    ("89504E470D0A1A0A", "png", "image/png", "image", "PNG Image"),
    ("FFD8FF", "jpg", "image/jpeg", "image", "JPEG Image"),
    ("47494638", "gif", "image/gif", "image", "GIF Image"),
    ("424D", "bmp", "image/bmp", "image", "BMP Image"),
    ("3C3F706870", "php", "application/x-php", "script", "PHP Script"),
    ("2321", "sh", "text/x-shellscript", "script", "Shell Script"),
    ("53514C69746520666F726D61742033", "sqlite", "application/x-sqlite3", "database", "SQLite Database"),
]
# What looks like code.
CODE_LIKE = [r"\bfunction\s{1,10}\w{1,50}\s{0,5}\(", r"\bclass\s{1,10}\w{1,50}", r"\b(if|for|while)\s{0,5}\(", r"\$\w{1,50}\s{0,5}=", r"\beval\s{0,5}\(", r"<\?php"]
# Content types that the quick filter passes over, and sinks whose arguments are looked at.
SAFE_TYPES = ["image/", "video/", "audio/", "font/", "application/pdf", "application/zip", "application/gzip", "text/css", "text/plain"]
TAINT_SINKS = "eval|assert|system|exec|shell_exec|passthru|call_user_func|call_user_func_array|create_function|preg_replace|include|include_once|require|require_once|file_put_contents|unserialize"
# Sinks of each detector with their weights, in the order that they are looked up.
SINKS = {
    "sqli": [("mysql_query", 60), ("mysqli_query", 60), ("pg_query", 60), ("sqlite_query", 60), ("mssql_query", 60), ("odbc_exec", 60), ("db2_exec", 60), ("oci_execute", 60), ("pdo_query", 55), ("query", 50), ("execute", 45), ("exec", 45), ("raw", 40)],
    "xss": [("echo", 50), ("print", 50), ("print_r", 45), ("printf", 50), ("sprintf", 45), ("vprintf", 50), ("document.write", 70), ("document.writeln", 70), ("innerhtml", 65), ("outerhtml", 60), ("insertadjacenthtml", 60), ("eval", 80), ("function", 40), ("settimeout", 55), ("setinterval", 55), ("htmlspecialchars", -20), ("htmlentities", -20), ("strip_tags", -15)],
    "rce": [("eval", 100), ("assert", 90), ("create_function", 95), ("call_user_func", 75), ("call_user_func_array", 75), ("preg_replace", 60), ("system", 100), ("exec", 100), ("shell_exec", 100), ("passthru", 100), ("popen", 95), ("proc_open", 95), ("pcntl_exec", 100), ("include", 85), ("include_once", 85), ("require", 85), ("require_once", 85), ("unserialize", 85), ("__import__", 90), ("subprocess", 95)],
    "xxe": [("simplexml_load_string", 70), ("simplexml_load_file", 75), ("dom_import_simplexml", 60), ("xml_parse", 65), ("xmlreader", 60), ("domdocument", 65), ("loadxml", 70), ("load", 50), ("libxml_disable_entity_loader", -50)],
    "ssrf": [("file_get_contents", 70), ("fopen", 60), ("curl_init", 75), ("curl_exec", 80), ("curl_setopt", 50), ("fsockopen", 85), ("pfsockopen", 85), ("socket_connect", 85), ("get_headers", 60), ("getimagesize", 55), ("imagecreatefromjpeg", 50), ("imagecreatefrompng", 50), ("imagecreatefromgif", 50), ("requests.get", 70), ("requests.post", 70), ("urllib.request.urlopen", 75), ("httplib", 65)],
    "traversal": [("file_get_contents", 70), ("file", 60), ("fopen", 65), ("fread", 60), ("readfile", 70), ("highlight_file", 75), ("show_source", 75), ("include", 85), ("include_once", 85), ("require", 85), ("require_once", 85), ("opendir", 50), ("readdir", 45), ("scandir", 55), ("glob", 50), ("basename", -20), ("realpath", -25)],
    "cmdi": [("system", 100), ("exec", 100), ("shell_exec", 100), ("passthru", 100), ("popen", 95), ("proc_open", 95), ("pcntl_exec", 100), ("backticks", 90), ("os.system", 100), ("os.popen", 95), ("subprocess.call", 95), ("subprocess.run", 95), ("subprocess.popen", 100), ("escapeshellcmd", -30), ("escapeshellarg", -30)],
    "deser": [("unserialize", 90), ("maybe_unserialize", 85), ("__wakeup", 60), ("__destruct", 60), ("__toString", 50), ("__call", 55), ("pickle.loads", 95), ("pickle.load", 95), ("cPickle.loads", 95), ("ObjectInputStream", 90), ("readObject", 85), ("yaml.load", 85), ("yaml.unsafe_load", 100), ("json_decode", -10), ("yaml.safe_load", -20)],
    "upload": [("move_uploaded_file", 80), ("copy", 60), ("file_put_contents", 70), ("fwrite", 55), ("fputs", 55), ("pathinfo", 30), ("basename", 20), ("getimagesize", -15), ("finfo_file", -20), ("exif_imagetype", -20)],
}
# Substrings that mark a flag.
FLAG_WORDS = ["flag{", "ctf{", "ctfhub{", "key{", "secret{", "{flag", "flag:", "key:"]
# Commands whose line an attacker's text shows, and the words of shell commands, files and SQL.
SHELL_LINES = ["whoami", "id", "uname", "ifconfig", "ipconfig", "netstat", "cat ", "ls ", "dir ", "pwd", "cd ", "wget ", "curl ", "chmod ", "chown ", "find ", "grep ", "ps ", "kill ", "net ", "ping ", "nslookup", "type ", "echo ", "certutil", "powershell", "cmd /c", "cmd.exe"]
# How a first Behinder 4 request begins.
BEHINDER_FIRST = ["dFAXQV1LORcHRQtLRlwMAhwFTAg/M", "dFAXQV1LORcHRQ"]
# Extensions that are known at all.
KNOWN = [
    ".zip", ".rar", ".7z", ".tar", ".gz", ".bz2", ".cab", ".exe", ".dll", ".so", ".elf", ".bin", ".msi", ".php", ".jsp", ".asp", ".aspx", ".py", ".sh", ".bat", ".ps1", ".vbs", ".js",
    ".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx", ".sql", ".db", ".sqlite", ".mdb", ".png", ".jpg", ".jpeg", ".gif", ".bmp", ".ico", ".svg",
    ".txt", ".log", ".cfg", ".conf", ".ini", ".xml", ".json", ".html", ".htm", ".css",
]
