"""Fixed word lists, tables and patterns of the query language over code."""

# Words that carry no meaning in a question about code.
STOPWORDS = (
    "a an the is are was were be been being do does did have has had in on at by for with to from of and or but if then "
    "than so as this that these those what where when who why how which whom whose does do did can could should would "
    "will shall may might must code function method symbol logic handles handle handled handling happens happen "
    "happening look looking find show tell exists exist me i you we they it its their there here thing things stuff"
).split()

# Words whose stem is not what the suffix rules give.
LEMMAS = {
    "analysis": "analyz", "analyses": "analyz", "analytic": "analyz", "analytical": "analyz",
    "synthesis": "synthesiz", "syntheses": "synthesiz", "hypothesis": "hypothesiz", "hypotheses": "hypothesiz",
    "diagnosis": "diagnos", "diagnoses": "diagnos", "clean": "clear", "cleans": "clear", "cleanup": "clear",
    "cleaning": "clear", "cleaned": "clear", "delete": "remov", "deletes": "remov", "deleting": "remov",
    "deleted": "remov", "deletion": "remov", "begin": "start", "begins": "start", "beginning": "start",
    "finish": "end", "finishes": "end", "finishing": "end", "finished": "end", "complete": "end",
    "completes": "end", "completed": "end", "completion": "end", "query": "queri", "queries": "queri",
    "dependency": "dependenci", "dependencies": "dependenci", "entity": "entiti", "entities": "entiti",
    "entry": "entri", "entries": "entri", "strategy": "strategi", "strategies": "strategi", "category": "categori",
    "categories": "categori", "policy": "polici", "policies": "polici", "summary": "summari",
    "summaries": "summari", "history": "histori", "histories": "histori", "library": "librari",
    "libraries": "librari", "registry": "registri", "registries": "registri", "factory": "factori",
    "factories": "factori", "property": "properti", "properties": "properti", "logger": "log", "loggers": "log",
    "runner": "run", "runners": "run", "mapper": "map", "mappers": "map", "zipper": "zip", "zippers": "zip",
    "stripper": "strip", "strippers": "strip", "planner": "plan", "planners": "plan", "scanner": "scan",
    "scanners": "scan", "spinner": "spin", "spinners": "spin",
}

# Suffixes in the order in which they are tried.
SUFFIXES = "ations ization tions sions ation tion sion ings ers ies ing ed er es ly s".split()

# Symbol names that are everyday words.
COMMON_NOUNS = (
    "main new test run get set type kind all none some default base root item key name file path line byte time size "
    "list map string number id self this error result value data info state"
).split()

# Question words that ask for a kind of symbol.
KIND_HINTS = {
    "type": "struct enum type trait interface class union".split(),
    "struct": ["struct"],
    "trait": ["trait", "interface"],
    "interface": ["interface", "trait"],
    "class": ["class", "struct", "interface", "trait"],
    "enum": ["enum"],
    "function": ["fn", "function", "method"],
    "method": ["method", "fn"],
    "module": ["module", "mod"],
}

# Stop words of lexical retrieval.
LEXICAL_STOPWORDS = "the a an of to in for and or with on is".split()

# Names never ranked, and names not ranked unless they are defined.
ALWAYS_FILTERED = ["Ok", "Err", "Some", "None"]
PRELUDE = (
    "Promise Error TypeError RangeError SyntaxError Number String Boolean Symbol Date parseInt parseFloat isNaN isFinite "
    "setTimeout setInterval clearTimeout clearInterval encodeURIComponent decodeURIComponent encodeURI decodeURI require "
    "print len str int float bool bytes list dict tuple set frozenset range enumerate zip map filter sorted reversed sum "
    "min max abs round type isinstance issubclass hasattr getattr setattr delattr callable super repr hash id dir vars "
    "locals globals open input iter next all any format chr ord hex oct bin make new cap append copy delete panic recover "
    "println complex real imag malloc calloc realloc free memcpy memmove memset memcmp strcpy strncpy strcat strncat "
    "strcmp strncmp strlen strchr strstr strtok strdup printf fprintf sprintf snprintf vprintf scanf fscanf sscanf fopen "
    "fclose fread fwrite fseek ftell fflush fgets fputs fgetc fputc feof ferror exit abort atexit getenv system assert "
    "atoi atol atof Integer Long Double Float Character ArrayList HashMap HashSet LinkedList echo isset empty unset count "
    "array var_dump print_r is_array is_string is_int is_null is_object is_bool is_numeric puts p pp raise "
    "require_relative attr_accessor attr_reader attr_writer precondition fatalError"
).split()

# File extensions by language, and extensions whose content is indexed.
LANGUAGES = {
    "rust": "rs", "python": "py", "typescript": "ts tsx", "javascript": "js jsx mjs cjs", "go": "go", "java": "java",
    "c": "c h", "cpp": "cpp cc cxx hpp hh hxx", "php": "php phtml", "ruby": "rb rake", "swift": "swift",
    "csharp": "cs csx", "markdown": "md markdown",
}
INDEXED_EXTENSIONS = (
    "rs py ts tsx js jsx go java c h cpp hpp cc cs php rb swift kt md markdown toml yaml yml json xml"
).split()

# Path patterns of secrets (any case) and of editors' temporary files.
SECRETS = (
    r"(?i)((^|/)\.env(\..*)?$|(^|/)id_(rsa|dsa|ecdsa|ed25519)(\.pub)?$|\.(pem|p12|pfx|key|kdbx|jks|crt|cer)$"
    r"|.*credentials.*\.json$|(^|/)\.aws/(credentials|config)$|(^|/)\.npmrc$|(^|/)\.pypirc$|(^|/)\.htpasswd$)"
)
EDITOR_FILES = (
    r"((^|/)\.[^/]+\.sw[a-p]$|(^|/)4913$|~$|(^|/)\.#[^/]+$|(^|/)#[^/]+#$|___jb_(tmp|old|bak)___$"
    r"|(^|/)\.idea/.*\.(tmp|xml\.tmp)$|(^|/)\.vscode/.*\.tmp$|\.code-workspace\.tmp$|\.tmp(\.\d+)?$|\.swp$|\.part$|\.crdownload$)"
)

# Synonyms of symbol kinds; anything unknown is `other`.
KINDS = {
    "fn": "fn function func def", "method": "method", "class": "class", "struct": "struct record", "enum": "enum enum_class",
    "trait": "trait interface protocol", "type": "type type_alias typealias", "const": "const constant", "static": "static",
    "module": "module namespace", "heading": "heading",
}
VISIBILITIES = {"public": "public pub", "private": "private priv", "crate": "crate pub(crate)", "protected": "protected"}
