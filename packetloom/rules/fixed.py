"""Fixed values of the detectors: patterns with weights, word lists and tables, in their natural order."""

# Attack patterns, name -> (pattern, weight); matched in either case, dots match newlines.

SQLI = {
    'union_select': (r"UNION\s{1,10}(ALL\s{1,10})?SELECT\s", 80),
    'union_select_null': (r"UNION\s{1,10}SELECT\s{1,10}NULL", 85),
    'or_true': (r"'\s{0,5}OR\s{0,5}'?\d{1,5}'\s{0,5}=\s{0,5}'?\d{1,5}", 70),
    'or_true_v2': (r"'\s{0,5}OR\s{0,5}1\s{0,5}=\s{0,5}1", 75),
    'and_true': (r"'\s{0,5}AND\s{0,5}1\s{0,5}=\s{0,5}1", 65),
    'and_false': (r"'\s{0,5}AND\s{0,5}'?\d{1,5}'\s{0,5}=\s{0,5}'?\d{1,5}", 60),
    'sleep_attack': (r"SLEEP\s{0,5}\(\s{0,5}\d{1,10}\s{0,5}\)", 90),
    'benchmark': (r"BENCHMARK\s{0,5}\(\s{0,5}\d{1,15}\s{0,5},", 90),
    'waitfor_delay': (r"""WAITFOR\s{1,10}DELAY\s{1,10}['\"]""", 90),
    'load_file': (r"LOAD_FILE\s{0,5}\(", 95),
    'into_outfile': (r"INTO\s{1,10}(OUT|DUMP)FILE\s", 95),
    'information_schema': (r"INFORMATION_SCHEMA\.(TABLES|COLUMNS|SCHEMATA)", 70),
    'line_comment': (r"--\s{0,3}$", 30),
    'hash_comment': (r"#\s{0,3}$", 30),
    'inline_comment_bypass': (r"/\*!\d{0,6}\s{0,5}\w{1,20}\s{0,5}\*/", 60),
    'hex_string': (r"0x[0-9a-fA-F]{8,64}", 40),
    'char_function': (r"CHAR\s{0,5}\(\s{0,5}\d{1,5}(\s{0,5},\s{0,5}\d{1,5}){0,20}\s{0,5}\)", 50),
    'extractvalue': (r"EXTRACTVALUE\s{0,5}\(", 70),
    'updatexml': (r"UPDATEXML\s{0,5}\(", 70),
    'stacked_query': (r";\s{0,5}(SELECT|INSERT|UPDATE|DELETE|DROP)\s", 80),
}

WAF_BYPASS = {
    'case_bypass': (r"(?:UnIoN|sElEcT|SeLeCt|uNiOn)", 40),
    'space_bypass': (r"UNION\s*/\*\*/\s*SELECT", 50),
    'plus_bypass': (r"UNION\+SELECT", 45),
}

XSS = {
    'script_tag': (r"<script[^>]{0,200}>[^<]{0,1000}</script>", 80),
    'script_open': (r"<script[^>]{0,200}>", 60),
    'onerror': (r"\bon(error|load|click|mouseover|mouseout|keydown|keyup)\s{0,5}=", 70),
    'javascript_uri': (r"javascript\s{0,5}:", 75),
    'eval_call': (r"\beval\s{0,5}\(", 60),
    'document_write': (r"document\.(write|writeln)\s{0,5}\(", 55),
    'innerhtml': (r"\.innerHTML\s{0,5}=", 50),
    'document_cookie': (r"document\.cookie", 45),
    'svg_onload': (r"<svg[^>]{0,100}\bonload\s{0,5}=", 75),
    'img_onerror': (r"<img[^>]{0,100}\bonerror\s{0,5}=", 70),
    'location_assign': (r"location\s{0,5}=|location\.(href|assign|replace)\s{0,5}=", 50),
    'document_domain': (r"document\.domain\s{0,5}=", 55),
}

RCE = {
    'eval': (r"\beval\s{0,5}\(", 90),
    'assert': (r"\bassert\s{0,5}\(", 80),
    'create_function': (r"\bcreate_function\s{0,5}\(", 85),
    'preg_replace_e': (r"""preg_replace\s{0,5}\([^)]{0,100}['\"][^'\"]{0,50}e[imsuxADSUXJ]{0,10}['\"]""", 95),
    'call_user_func': (r"call_user_func(_array)?\s{0,5}\(", 70),
    'system': (r"\bsystem\s{0,5}\(", 95),
    'exec': (r"\bexec\s{0,5}\(", 95),
    'shell_exec': (r"\bshell_exec\s{0,5}\(", 95),
    'passthru': (r"\bpassthru\s{0,5}\(", 95),
    'popen': (r"\b(popen|proc_open)\s{0,5}\(", 90),
    'backtick': (r"`[^`]{1,500}`", 80),
    'include_dynamic': (r"\b(include|require)(_once)?\s{0,5}\(\s{0,5}\$", 85),
    'variable_function': (r"\$[a-zA-Z_]\w{0,50}\s{0,5}\(", 60),
    'variable_variable': (r"\$\{\s{0,5}\$", 70),
    'unserialize': (r"\bunserialize\s{0,5}\(", 80),
    'phar_wrapper': (r"phar://", 85),
    'python_exec': (r"\bexec\s{0,5}\(|__import__\s{0,5}\(", 90),
    'os_system': (r"os\.(system|popen|spawn)", 90),
    'subprocess': (r"subprocess\.(call|run|Popen)", 90),
    'ssti_jinja': (r"\{\{\s{0,10}[^}]{1,200}\s{0,10}\}\}", 50),
    'ssti_freemarker': (r"\$\{\s{0,10}[^}]{1,200}\s{0,10}\}", 45),
    'jsp_scriptlet': (r"<%[!@]?\s{0,10}(class|import|extends)", 70),
    'jsp_classloader': (r"extends\s{1,10}ClassLoader", 95),
    'jsp_defineclass': (r"defineClass\s{0,5}\(", 100),
    'jsp_runtime_exec': (r"Runtime\s{0,5}\.\s{0,5}getRuntime\s{0,5}\(\s{0,5}\)\s{0,5}\.\s{0,5}exec", 100),
    'jsp_processbuilder': (r"ProcessBuilder\s{0,5}\(", 90),
    'java_reflection': (r"\.getMethod\s{0,5}\(|\.invoke\s{0,5}\(|\.forName\s{0,5}\(", 75),
    'java_classforname': (r"Class\.forName\s{0,5}\(", 80),
    'godzilla_key': (r"""String\s{1,10}xc\s{0,5}=\s{0,5}[\"'][0-9a-f]{16}[\"']""", 95),
    'godzilla_md5': (r"md5\s{0,5}\(\s{0,5}pass\s{0,5}\+\s{0,5}xc\s{0,5}\)", 95),
    'behinder_java': (r"AES/CBC/PKCS5Padding|javax\.crypto\.Cipher", 80),
    'jsp_request_param': (r"request\.(getParameter|getInputStream)", 50),
    'jsp_response_write': (r"response\.(getWriter|getOutputStream)", 40),
    'webshell_ini_set': (r"""@?ini_set\s{0,5}\(\s{0,5}['\"]display_errors['\"]""", 60),
    'webshell_error_reporting': (r"@?error_reporting\s{0,5}\(\s{0,5}0\s{0,5}\)", 55),
    'webshell_set_time_limit': (r"@?set_time_limit\s{0,5}\(\s{0,5}0\s{0,5}\)", 50),
    'webshell_ignore_abort': (r"ignore_user_abort\s{0,5}\(\s{0,5}(true|1)\s{0,5}\)", 50),
    'webshell_openssl_decrypt': (r"openssl_decrypt\s{0,5}\([^)]{0,100}\$_(POST|GET|REQUEST)", 80),
    'webshell_openssl_aes': (r"openssl_decrypt\s{0,5}\([^)]{0,100}AES", 60),
    'webshell_base64_decode_post': (r"base64_decode\s{0,5}\(\s{0,5}\$_(POST|GET|REQUEST)", 75),
    'webshell_gzinflate': (r"gzinflate\s{0,5}\(\s{0,5}base64_decode", 80),
    'webshell_chr_concat': (r"chr\s{0,5}\(\s{0,5}\d+\s{0,5}\)\s{0,5}\.\s{0,5}chr\s{0,5}\(", 60),
}

XXE = {
    'entity_system': (r"""<!ENTITY\s{1,10}\w{1,50}\s{1,10}SYSTEM\s{1,10}['\"]""", 90),
    'entity_public': (r"""<!ENTITY\s{1,10}\w{1,50}\s{1,10}PUBLIC\s{1,10}['\"]""", 85),
    'parameter_entity': (r"<!ENTITY\s{1,10}%\s{0,5}\w{1,50}\s{1,10}(SYSTEM|PUBLIC)", 90),
    'external_dtd': (r"""<!DOCTYPE[^>]{0,200}SYSTEM\s{1,10}['\"][^'\"]{1,500}['\"]""", 85),
    'file_protocol': (r"""file://[^'\"\s>]{1,500}""", 95),
    'php_protocol': (r"php://(input|filter|data)", 95),
    'expect_protocol': (r"expect://", 100),
}

DANGEROUS_PROTOCOLS = {
    'file://': 100,
    'php://': 95,
    'expect://': 100,
    'gopher://': 90,
    'dict://': 80,
    'data://': 70,
}

SSRF = {
    'loopback': (r"\b127\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", 100),
    'localhost': (r"\blocalhost\b", 100),
    'class_a_private': (r"\b10\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", 80),
    'class_b_private': (r"\b172\.(1[6-9]|2\d|3[01])\.\d{1,3}\.\d{1,3}\b", 80),
    'class_c_private': (r"\b192\.168\.\d{1,3}\.\d{1,3}\b", 80),
    'aws_metadata': (r"\b169\.254\.169\.254\b", 100),
    'file_scheme': (r"\bfile://", 90),
    'gopher_scheme': (r"\bgopher://", 90),
    'dict_scheme': (r"\bdict://", 85),
    'ipv6_localhost': (r"\[::1\]|\[0:0:0:0:0:0:0:1\]", 100),
    'decimal_ip_in_url': (r"https?://\d{8,10}\b", 70),
}

TRAVERSAL = {
    'dot_dot_slash': (r"\.\.(/|\\)", 40),
    'url_encoded': (r"%2e%2e(%2f|%5c|/|\\)", 50),
    'double_encoded': (r"%252e%252e%252f", 60),
    'null_byte': (r"%00|\\x00", 60),
    'unicode_bypass': (r"%c0%ae%c0%ae|%e0%40%ae", 55),
}

SENSITIVE_FILES = {
    '/etc/passwd': 100,
    '/etc/shadow': 100,
    '.ssh/id_rsa': 95,
    'win.ini': 80,
    'web.config': 70,
    '.htaccess': 60,
    '.env': 75,
    'wp-config.php': 80,
    'config.php': 70,
}

CMDI = {
    'semicolon': (r";\s{0,10}(ls|cat|id|whoami|pwd|uname|curl|wget|nc|bash|sh)\b", 80),
    'pipe': (r"\|\s{0,10}(ls|cat|id|whoami|pwd|bash|sh)\b", 75),
    'ampersand': (r"&{1,2}\s{0,10}(ls|cat|id|whoami|pwd)\b", 70),
    'backtick_cmd': (r"`[^`]{1,200}`", 70),
    'dollar_paren': (r"\$\([^)]{1,200}\)", 70),
    'reverse_shell': (r"(nc|ncat|netcat)\s{1,20}[^\s]{1,50}\s{1,20}\d{1,5}\s{1,10}-e\s{1,10}(ba)?sh", 100),
    'bash_reverse': (r"bash\s{1,10}-i\s{1,10}>&", 100),
    'curl_pipe': (r"curl\s{1,50}[^\|]{1,200}\|\s{0,10}(ba)?sh", 90),
    'wget_pipe': (r"wget\s{1,50}[^\|]{1,200}\|\s{0,10}(ba)?sh", 90),
}

DESER = {
    'php_serialize': (r"[OaCsrib]:\d{1,10}:", 60),
    'php_object': (r'O:\d{1,10}:"[^"]{1,100}":\d{1,5}:', 70),
    'java_magic': (r"(\xac\xed\x00\x05|rO0AB)", 80),
    'pickle_reduce': (r"c__builtin__|cposix|cos\n", 80),
    'yaml_tag': (r"!!python/object", 85),
    'dotnet_type': (r"""\$type["\']?\s{0,5}:""", 75),
}

DANGEROUS_EXTENSIONS = {
    '.php': 100,
    '.php3': 95,
    '.php4': 95,
    '.php5': 95,
    '.phtml': 95,
    '.phar': 95,
    '.jsp': 100,
    '.jspx': 95,
    '.jsw': 90,
    '.jsv': 90,
    '.asp': 100,
    '.aspx': 100,
    '.asa': 95,
    '.asax': 90,
    '.ascx': 90,
    '.ashx': 90,
    '.cfm': 90,
    '.cfc': 90,
    '.exe': 100,
    '.dll': 95,
    '.bat': 90,
    '.cmd': 90,
    '.com': 90,
    '.sh': 85,
    '.bash': 85,
    '.zsh': 85,
    '.py': 80,
    '.pl': 80,
    '.rb': 80,
    '.htaccess': 90,
    '.htpasswd': 90,
    'web.config': 85,
    '.config': 70,
}

UPLOAD = {
    'content_disposition': (r"""Content-Disposition[^;]*filename\s*=\s*["\']?([^"\';\r\n]+)""", 30),
    'multipart_boundary': (r"boundary=[-\w]+", 20),
    'php_magic': (r"<\?php|<\?=", 80),
    'jsp_magic': (r"<%@\s*page|<%\s*import", 80),
    'asp_magic': (r"""<%\s*@\s*language|<script\s+runat\s*=\s*["\']?server""", 80),
    'double_extension': (r"\.(php|jsp|asp|aspx|exe)\.(jpg|png|gif|jpeg|bmp|ico)", 90),
    'null_byte_bypass': (r"\.(php|jsp|asp|aspx|exe)%00\.(jpg|png|gif)", 95),
}

# Web-shell indicators, (name, pattern, weight, dots match newlines).
ANTSWORD_INDICATORS = [
    ('php_ini_set', r"""@ini_set\s*\(\s*["\']display_errors["\']""", 90, False),
    ('set_time_limit', r"@set_time_limit\s*\(\s*0\s*\)", 70, False),
    ('error_reporting', r"@error_reporting\s*\(\s*0\s*\)", 60, False),
    ('eval_var', r"eval\s*\(\s*[\$@]", 50, False),
    ('assert_var', r"assert\s*\(\s*[\$@]", 50, False),
    ('create_function', r"create_function\s*\(", 55, False),
    ('preg_replace_e', r"""preg_replace\s*\([^)]*["\'][^"\']*\/[^\/]*e""", 60, False),
    ('gzinflate', r"gzinflate\s*\(", 45, False),
    ('gzuncompress', r"gzuncompress\s*\(", 45, False),
    ('str_rot13', r"str_rot13\s*\(", 40, False),
    ('base64_decode', r"base64_decode\s*\([^)]*\)", 40, False),
    ('call_user_func', r"call_user_func", 35, False),
    ('call_user_func_array', r"call_user_func_array", 35, False),
    ('obfuscated_var', r"_0x[a-fA-F0-9]{4,}", 30, False),
    ('chr_obfuscation', r"chr\s*\(\s*\d+\s*\)", 25, False),
    ('post_access', r"\$_POST\s*\[", 20, False),
    ('get_access', r"\$_GET\s*\[", 20, False),
    ('request_access', r"\$_REQUEST\s*\[", 20, False),
    ('cookie_access', r"\$_COOKIE\s*\[", 15, False),
    ('array_map_callback', r"""array_map\s*\(\s*[\'"]""", 30, False),
    ('array_filter_callback', r"""array_filter\s*\(\s*[^,]+,\s*[\'"]""", 30, False),
    ('usort_callback', r"""usort\s*\(\s*[^,]+,\s*[\'"]""", 30, False),
]

CAIDAO_INDICATORS = [
    ('caidao_ini_b64', r"[a-zA-Z_]\w*=QGluaV9zZXQ", 95, False),
    ('caidao_z_base64', r"z\d+=.*base64_decode", 80, False),
    ('caidao_action_pattern', r"action=\w+&[a-zA-Z]\d+=", 70, False),
    ('caidao_z_long_b64', r"z\d+=[\w\+/=]{50,}", 60, False),
]

BEHINDER_INDICATORS = [
    ('openssl_decrypt', r"openssl_decrypt\s*\(", 70, False),
    ('aes_128_cbc', r"AES-128-CBC", 60, False),
    ('behinder_class_pattern', r"class\s+\w+\s*\{\s*function\s+__construct\s*\(\s*\)", 50, False),
    ('behinder4_eval_post', r"eval\s*\(\s*\$post\s*\)", 85, False),
    ('behinder4_decrypt_post', r"\$post\s*=\s*Decrypt\s*\(", 90, False),
    ('behinder4_php_input_decrypt', r"""Decrypt\s*\(\s*file_get_contents\s*\(\s*["\']php://input["\']""", 95, False),
    ('behinder4_error_reporting', r"@error_reporting\s*\(\s*0\s*\)\s*;", 60, False),
    ('reflection_class', r"new\s+ReflectionClass", 45, False),
    ('define_class', r"defineClass\s*\(", 50, False),
    ('java_cipher', r"javax\.crypto\.Cipher", 55, False),
    ('runtime_exec', r"getRuntime\s*\(\s*\)\s*\.exec", 65, False),
    ('session_start', r"session_start\s*\(\s*\)", 30, False),
    ('session_access', r"""\$_SESSION\s*\[\s*[\'"][^\'"]+[\'"]\s*\]""", 25, False),
    ('behinder_php_shell', r"@error_reporting\s*\(\s*0\s*\).*openssl", 75, True),
    ('behinder_decrypt_func', r"function\s+\w+\s*\(\s*\$\w+\s*\)\s*\{.*return.*openssl", 70, True),
    ('base64_decode_post', r"base64_decode\s*\(\s*\$_POST", 55, False),
    ('php_input', r"""\$post\s*=\s*file_get_contents\s*\(\s*[\'"]php://input[\'"]\s*\)""", 60, False),
    ('method_body_var', r"methodBody\s*=", 45, False),
    ('current_path_var', r"currentPath\s*=", 40, False),
    ('exec_command_func', r"execCommand", 55, False),
    ('file_operation_func', r"fileOperation", 50, False),
]

GODZILLA_INDICATORS = [
    ('godzilla_run_post', r"""run\s*\(\s*\$_POST\s*\[\s*[\'"][^\'"]+[\'"]\s*\]\s*\)""", 80, False),
    ('godzilla_classloader', r"class\s+\w+\s*extends\s+ClassLoader", 75, False),
    ('godzilla_method_body', r"methodBody\s*=", 60, False),
    ('godzilla_session', r"session_start\s*\(\s*\)\s*;.*\$_SESSION", 40, True),
    ('godzilla_e_post', r"E\s*\(\s*\$_POST\s*\[", 55, False),
    ('godzilla_session_start', r"@session_start\s*\(\s*\)\s*;", 35, False),
    ('godzilla_session_key', r"\$key\s*=\s*@?\$_SESSION\s*\[", 50, False),
    ('godzilla_ini_set', r"""@ini_set\s*\(\s*["\']display_errors["\']""", 40, False),
]

RESPONSE_INDICATORS = [
    ('antsword_marker', r"\[S\].*?\[E\]", 85, True),
    ('path_marker', r"->\./", 60, False),
    ('caidao_xay_marker', r"X@Y", 70, False),
    ('caidao_path_prefix', r"->\|", 65, False),
    ('caidao_delimiter', r"\|\|[^|]+\|\|", 50, False),
    ('id_command_output', r"uid=\d+\([^)]+\)\s+gid=\d+", 80, False),
    ('ipconfig_output', r"Windows IP Configuration", 75, False),
    ('dir_command_output', 'Directory of [C-Z]:\\\\', 75, False),
    ('ls_command_output', r"total\s+\d+.*?drwx", 70, True),
    ('etc_passwd_output', r"(root|admin|www-data):[x*]:\d+:\d+:", 75, False),
    ('boot_ini_output', r"\[boot loader\]", 65, False),
    ('php_error', r"(Parse error|Fatal error|Warning):\s+.+\s+in\s+.+\s+on line\s+\d+", 35, False),
]

# Parameter names, (name, pattern anchored at the start, weight).
SUSPICIOUS_PARAMS = [
    ('obfuscated_param', r"^_0x[a-fA-F0-9]+$", 35),
    ('short_indexed_param', r"^[a-z]{1,2}\d{1,2}$", 20),
    ('ant_prefix', r"^ant[_-]?", 40),
    ('dangerous_param_name', r"^(cmd|exec|shell|payload|code)$", 30),
    ('md5_param_name', r"^[a-f0-9]{32}$", 25),
]

PARAM_NAME_WHITELIST = [
    'password', 'passwd', 'pass', 'pwd', 'token', 'csrf', 'csrftoken', 'session', 'sessionid', 'auth',
    'key', 'secret', 'api_key', 'apikey', 'username', 'user', 'login', 'email', 'phone', 'mobile',
    'callback', 'jsonp', 'format', 'type', 'action', 'method', 'page', 'size', 'limit', 'offset',
    'sort', 'order', 'id', 'uid', 'pid', 'cid', 'tid', 'fid', 'name', 'title',
    'content', 'body', 'text', 'message', 'msg', 'file', 'path', 'url', 'src', 'href',
    'link', 'time', 'date', 'timestamp', 'created', 'updated', 'status', 'state', 'code', 'result',
    'error', 'data', 'info', 'list', 'items', 'records', 'q', 's', 'search', 'query',
    'keyword', 'keywords', 'v', 'version', 'lang', 'language', 'locale', '_', '__', '_t',
    '_r', 'r', 't', 'n',
]

BEHINDER_DEFAULT_KEYS = [
    'e45e329feb5d925b', '1234567890123456', '0123456789abcdef', 'abcdef0123456789', 'password12345678',
    'admin12345678901', 'root123456789012', 'test123456789012', 'shell12345678901', 'behinder12345678',
    'webshell12345678', 'hackme1234567890', 'secretkey1234567', 'xc3x4rs5xyzw6789', 'bx4ut56rs3xyzabc',
    '5f4dcc3b5aa765d6', '21232f297a57a5a7', '63a9f0ea7bb98050', '098f6bcd4621d373', 'c4ca4238a0b92382',
    'c81e728d9d4c2f63', 'e10adc3949ba59ab', 'd41d8cd98f00b204', '827ccb0eea8a706c', '25d55ad283aa400a',
    'fcea920f7412b5da', '0192023a7bbd7324', '7c4a8d09ca3762af', 'aaaaaaaaaaaaaaaa', '0000000000000000',
    'ffffffffffffffff', 'key1234567890123', 'pass123456789012', 'adminadminadmina', 'rootrootrootroot',
]

GODZILLA_DEFAULT_KEYS = [
    'key', 'pass', '3c6e0b8a9c15224a', 'password', 'admin',
    'root', 'shell', 'test', '123456', 'godzilla',
    'webshell', 'hack', 'secret', '5f4dcc3b5aa765d6', '21232f297a57a5a7',
    'e10adc3949ba59ab', 'a', 'b', 'c', 'x',
    'y', 'z', '1', '2', '3',
]

# File signatures, (magic in hex as the match runs on hexadecimal text, offset, extension, description, MIME type, category).
FILE_SIGNATURES = [
    ('504b0304', 0, 'zip', 'ZIP Archive', 'application/zip', 'archive'),
    ('504b0506', 0, 'zip', 'ZIP Archive (empty)', 'application/zip', 'archive'),
    ('504b0708', 0, 'zip', 'ZIP Archive (spanned)', 'application/zip', 'archive'),
    ('1f8b08', 0, 'gz', 'GZIP Archive', 'application/gzip', 'archive'),
    ('425a68', 0, 'bz2', 'BZIP2 Archive', 'application/x-bzip2', 'archive'),
    ('fd377a585a00', 0, 'xz', 'XZ Archive', 'application/x-xz', 'archive'),
    ('526172211a0700', 0, 'rar', 'RAR Archive v1.5+', 'application/vnd.rar', 'archive'),
    ('526172211a070100', 0, 'rar', 'RAR Archive v5.0+', 'application/vnd.rar', 'archive'),
    ('377abcaf271c', 0, '7z', '7-Zip Archive', 'application/x-7z-compressed', 'archive'),
    ('7573746172', 257, 'tar', 'TAR Archive', 'application/x-tar', 'archive'),
    ('ffd8ff', 0, 'jpg', 'JPEG Image', 'image/jpeg', 'image'),
    ('89504e470d0a1a0a', 0, 'png', 'PNG Image', 'image/png', 'image'),
    ('474946383761', 0, 'gif', 'GIF Image (87a)', 'image/gif', 'image'),
    ('474946383961', 0, 'gif', 'GIF Image (89a)', 'image/gif', 'image'),
    ('424d', 0, 'bmp', 'BMP Image', 'image/bmp', 'image'),
    ('00000100', 0, 'ico', 'ICO Icon', 'image/x-icon', 'image'),
    ('52494646', 0, 'webp', 'WebP Image', 'image/webp', 'image'),
    ('49492a00', 0, 'tif', 'TIFF Image (Little Endian)', 'image/tiff', 'image'),
    ('4d4d002a', 0, 'tif', 'TIFF Image (Big Endian)', 'image/tiff', 'image'),
    ('494433', 0, 'mp3', 'MP3 Audio (ID3v2)', 'audio/mpeg', 'audio'),
    ('fffb', 0, 'mp3', 'MP3 Audio', 'audio/mpeg', 'audio'),
    ('fffa', 0, 'mp3', 'MP3 Audio', 'audio/mpeg', 'audio'),
    ('52494646', 0, 'wav', 'WAV Audio', 'audio/wav', 'audio'),
    ('4f676753', 0, 'ogg', 'OGG Audio', 'audio/ogg', 'audio'),
    ('664c6143', 0, 'flac', 'FLAC Audio', 'audio/flac', 'audio'),
    ('000000', 0, 'm4a', 'M4A/AAC Audio', 'audio/mp4', 'audio'),
    ('0000001c66747970', 0, 'mp4', 'MP4 Video', 'video/mp4', 'video'),
    ('0000002066747970', 0, 'mp4', 'MP4 Video', 'video/mp4', 'video'),
    ('1a45dfa3', 0, 'mkv', 'Matroska Video', 'video/x-matroska', 'video'),
    ('52494646', 0, 'avi', 'AVI Video', 'video/x-msvideo', 'video'),
    ('464c5601', 0, 'flv', 'FLV Video', 'video/x-flv', 'video'),
    ('000001ba', 0, 'mpg', 'MPEG Video', 'video/mpeg', 'video'),
    ('25504446', 0, 'pdf', 'PDF Document', 'application/pdf', 'document'),
    ('d0cf11e0a1b11ae1', 0, 'doc', 'MS Office Document (OLE)', 'application/msword', 'document'),
    ('504b030414000600', 0, 'docx', 'MS Word Document (OOXML)', 'application/vnd.openxmlformats-officedocument.wordprocessingml.document', 'document'),
    ('7b5c727466', 0, 'rtf', 'RTF Document', 'application/rtf', 'document'),
    ('4d5a', 0, 'exe', 'Windows Executable (PE)', 'application/x-msdownload', 'executable'),
    ('7f454c46', 0, 'elf', 'Linux Executable (ELF)', 'application/x-executable', 'executable'),
    ('cafebabe', 0, 'class', 'Java Class File', 'application/java-vm', 'executable'),
    ('feedface', 0, 'macho', 'macOS Executable (32-bit)', 'application/x-mach-binary', 'executable'),
    ('feedfacf', 0, 'macho', 'macOS Executable (64-bit)', 'application/x-mach-binary', 'executable'),
    ('cffaedfe', 0, 'macho', 'macOS Executable (64-bit, reversed)', 'application/x-mach-binary', 'executable'),
    ('53514c69746520666f726d61742033', 0, 'sqlite', 'SQLite Database', 'application/x-sqlite3', 'database'),
    ('2d2d2d2d2d424547494e', 0, 'pem', 'PEM Certificate', 'application/x-pem-file', 'security'),
    ('3082', 0, 'der', 'DER Certificate', 'application/x-x509-ca-cert', 'security'),
    ('2321', 0, 'sh', 'Shell Script (shebang)', 'text/x-shellscript', 'script'),
    ('3c3f706870', 0, 'php', 'PHP Script', 'application/x-php', 'script'),
    ('3c3f786d6c', 0, 'xml', 'XML Document', 'application/xml', 'script'),
    ('0000000000000000', 0, 'pcap', 'PCAP Capture (null)', 'application/vnd.tcpdump.pcap', 'network'),
    ('d4c3b2a1', 0, 'pcap', 'PCAP Capture (Little Endian)', 'application/vnd.tcpdump.pcap', 'network'),
    ('a1b2c3d4', 0, 'pcap', 'PCAP Capture (Big Endian)', 'application/vnd.tcpdump.pcap', 'network'),
    ('0a0d0d0a', 0, 'pcapng', 'PCAPNG Capture', 'application/vnd.tcpdump.pcap', 'network'),
]

# Encodings with the text that each is tried on, least length and rank; one pattern for each delimiter.
ENCODINGS = [
    ("base64", r"^\s*(?:[A-Za-z0-9+/]{4})+(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?\s*$", 4, 10),
    ("base64url", r"^\s*[A-Za-z0-9\-_]{20,}\s*$", 4, 10),
    ("base32", r"^(?:[A-Z2-7]{8})+(?:[A-Z2-7]{2}={6}|[A-Z2-7]{4}={4}|[A-Z2-7]{5}={3}|[A-Z2-7]{7}=)?$", 8, 15),
    ("hex", r"^(?:[0-9A-Fa-f]{2})+$", 4, 20),
    ("hex", r"^[0-9A-Fa-f]{2}(?: [0-9A-Fa-f]{2})+$", 4, 20),
    ("hex", r"^[0-9A-Fa-f]{2}(?::[0-9A-Fa-f]{2})+$", 4, 20),
    ("hex", r"(?i)^(?:0x[0-9A-Fa-f]{2})+$", 4, 20),
    ("hex", r"(?i)^(?:\\x[0-9A-Fa-f]{2})+$", 4, 20),
    ("url", r".*(?:%[0-9A-Fa-f]{2}.*){4}", 12, 25),
    ("binary", r"^(?:[01]{8})+$", 8, 30),
    ("binary", r"^[01]{8}(?: [01]{8})+$", 8, 30),
    ("octal", r"^(?:[0-7]{1,3})(?: (?:[0-7]{1,3}))+$", 3, 35),
    ("octal", r"^(?:[0-7]{1,3})(?:,(?:[0-7]{1,3}))+$", 3, 35),
    ("decimal", r"^(?:\d{1,2}|1\d{2}|2[0-4]\d|25[0-5])(?: (?:\d{1,2}|1\d{2}|2[0-4]\d|25[0-5]))+$", 3, 35),
    ("decimal", r"^(?:\d{1,2}|1\d{2}|2[0-4]\d|25[0-5])(?:,(?:\d{1,2}|1\d{2}|2[0-4]\d|25[0-5]))+$", 3, 35),
    ("html", r"&(?:#\d{2,5}|#x[0-9A-Fa-f]{2,4}|[a-zA-Z]{2,8});", 4, 40),
    ("base58", r"^[1-9A-HJ-NP-Za-km-z]{20,}$", 20, 45),
    ("morse", r"(?i)^[-.\s]+$|^[_.\s]+$", 5, 50),
    ("rot13", r"^[A-Za-z\s]{10,}$", 10, 60),
]
# Flags within texts.
FLAG_PATTERNS = [
    r"flag\{[^}]+\}",
    r"ctf\{[^}]+\}",
    r"key\{[^}]+\}",
    r"(?=.*[2-9a-f])[a-f0-9]{32}",
    r"(?=.*[2-9a-f])[a-f0-9]{64}",
]
# The Morse code.
MORSE = {
    ".-": "A", "-...": "B", "-.-.": "C", "-..": "D", ".": "E", "..-.": "F", "--.": "G", "....": "H", "..": "I", ".---": "J", "-.-": "K", ".-..": "L", "--": "M",
    "-.": "N", "---": "O", ".--.": "P", "--.-": "Q", ".-.": "R", "...": "S", "-": "T", "..-": "U", "...-": "V", ".--": "W", "-..-": "X", "-.--": "Y", "--..": "Z",
    "-----": "0", ".----": "1", "..---": "2", "...--": "3", "....-": "4", ".....": "5", "-....": "6", "--...": "7", "---..": "8", "----.": "9",
}

# URI patterns whose requests are harmless, and what they add.
NOISE = [("(/swagger|/api-docs|/openapi)", -50), (r"\.(js|css|png|jpg|gif|ico|woff|svg)$", -100), ("/(health|ping|status|ready|live)$", -80), ("(/metrics|/prometheus)", -60)]
# Extensions of programs that another extension hides.
DOUBLE_FROM = [".php", ".jsp", ".asp", ".aspx", ".exe", ".sh", ".py"]
DOUBLE_TO = [".jpg", ".jpeg", ".png", ".gif", ".bmp", ".ico"]
# Weak algorithms of secure shells.
WEAK_SSH = ["diffie-hellman-group1-sha1", "diffie-hellman-group-exchange-sha1", "arcfour", "arcfour128", "arcfour256", "aes128-cbc", "3des-cbc", "blowfish-cbc", "hmac-md5", "hmac-sha1-96", "hmac-md5-96"]
# PHP request variables, calls with the severity of tainted data in them, and calls that hide code.
PHP_SOURCES = ["$_GET", "$_POST", "$_REQUEST", "$_COOKIE", "$_FILES", "$_SERVER", "$_ENV", "$GLOBALS", "$HTTP_GET_VARS", "$HTTP_POST_VARS", "$HTTP_RAW_POST_DATA"]
PHP_SINKS = {
    "eval": 100, "assert": 90, "create_function": 85, "preg_replace": 70, "call_user_func": 75, "call_user_func_array": 75, "array_map": 60, "array_filter": 60, "usort": 55, "uasort": 55,
    "system": 100, "exec": 100, "shell_exec": 100, "passthru": 100, "popen": 90, "proc_open": 90, "pcntl_exec": 95,
    "include": 80, "include_once": 80, "require": 80, "require_once": 80, "file_put_contents": 70, "fwrite": 60, "fputs": 60, "file_get_contents": 40, "fopen": 40, "readfile": 40,
    "unserialize": 80,
}
PHP_HIDING = ["base64_decode", "str_rot13", "gzinflate", "gzuncompress", "gzdecode", "hex2bin", "strrev", "chr", "pack"]

# The quick filter's words: calls that run code, calls that hide it, calls on files, request data, dynamic calls.
FILTER_SINKS = ["eval", "assert", "create_function", "preg_replace", "system", "exec", "shell_exec", "passthru", "popen", "proc_open", "pcntl_exec", "call_user_func", "call_user_func_array", "array_map", "array_filter", "array_walk", "usort", "uasort", "uksort", "unserialize"]
FILTER_HIDING = ["base64_decode", "base64_encode", "gzinflate", "gzuncompress", "gzdecode", "str_rot13", "strrev", "chr", "ord", "pack", "unpack", "hex2bin", "bin2hex"]
FILTER_FILES = ["file_put_contents", "file_get_contents", "fopen", "fwrite", "fputs", "fread", "include", "include_once", "require", "require_once", "readfile", "file"]
FILTER_SOURCES = ["$_GET", "$_POST", "$_REQUEST", "$_COOKIE", "$_FILES", "$_SERVER", "$_ENV", "$GLOBALS", "php://input", "php://filter"]
FILTER_DYNAMIC = ["$$", "${", "->(", "::$"]

# USB usages of keys and their characters, and what shift makes of those that are no letters.
USB_KEYS = {0x04 + i: c for i, c in enumerate("abcdefghijklmnopqrstuvwxyz1234567890")} | {0x28: "\n", 0x2C: " ", 0x2D: "-", 0x2E: "=", 0x2F: "[", 0x30: "]", 0x31: "\\", 0x33: ";", 0x34: "'", 0x36: ",", 0x37: ".", 0x38: "/"}
USB_SHIFT = ("1234567890-=[]\\;',./", "!@#$%^&*()_+{}|:\"<>?")
