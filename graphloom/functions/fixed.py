"""Fixed values that results depend on: word lists, library names, layer words, languages."""

# Words dropped from search queries.
STOP_WORDS = (
    "a an the is are was were be been being have has had do does did will would could should may might shall can need must in on at to for of with by from as into "
    "through during before after above below and or not but if then else when where this that these those it its"
).split()

# Libraries whose calls are HTTP requests, broker messages or configuration.
HTTP_LIBRARIES = "requests axios httpx aiohttp urllib superagent node-fetch undici got fetch http.client reqwest hyper surf".split()
BROKER_LIBRARIES = "kafka amqp rabbitmq redis celery bull nats pulsar lapin rdkafka".split()
CONFIG_LIBRARIES = "dotenv config viper configparser pydantic_settings figment envy".split()

# Words of a path that place a file in a layer, in order of precedence.
LAYERS = (
    ("controllers", ("controller", "route", "handler", "resource", "endpoint")),
    ("services", ("service", "usecase", "use_case", "interactor")),
    ("repositories", ("repository", "repo", "dao", "store", "persistence")),
    ("models", ("model", "entity", "dto", "domain", "schema")),
    ("components", (".component.ts", ".component.tsx", ".component.js")),
    ("modules", (".module.ts",)),
    ("directives", (".directive.ts",)),
    ("pipes", (".pipe.ts",)),
    ("config", ("config", "configuration", "properties", "settings")),
    ("middleware", ("middleware", "interceptor", "filter", "guard")),
    ("utils", ("util", "helper", "common", "shared", "lib")),
)

# Words of a path and their rank in a request's way through the layers.
FLOW_RANKS = (("route", 0), ("controller", 1), ("handler", 1), ("service", 2), ("usecase", 2), ("repository", 3), ("repo", 3), ("store", 3), ("dao", 3), ("model", 4), ("entity", 4))

RANK_NAMES = {0: "route", 1: "controller", 2: "service", 3: "repository", 4: "model"}

# Words that don't tell projects apart, and suffixes of related project names.
GENERIC_NAME_WORDS = ("api", "app", "web", "service", "engine", "core", "frontend", "backend", "src", "main")
PROJECT_SUFFIXES = ("-engine", "-api", "-frontend", "-backend", "-service", "-web", "-app", "-core")

# Tokens that answering a question without each tool is taken to cost.
TOOL_COSTS = {
    15000: ("search_graph", "find_symbol", "search_code", "search_linked_projects"), 12000: ("find_references", "impact_analysis"), 10000: ("trace_call_path",), 8000: ("get_symbol_details",),
    6000: ("query_graph",), 800: ("get_code_snippet",), 2000: ("get_architecture", "get_graph_schema", "index_status", "list_projects", "list_project_links"),
}
OTHER_TOOL_COST = 3000

# Languages by file extension.
EXTENSIONS = {
    "ada": "adb ads", "astro": "astro", "awk": "awk", "bash": "bash sh", "c": "c", "clojure": "clj cljc cljs", "cmake": "cmake", "cobol": "cbl cob", "commonlisp": "cl lisp lsp", "cpp": "cc ccm cpp cppm cxx h hh hpp hxx ixx",
    "crystal": "cr", "csharp": "cs", "css": "css", "cuda": "cu cuh", "dart": "dart", "dlang": "d", "dockerfile": "dockerfile", "elixir": "ex exs", "elm": "elm", "emacslisp": "el", "erlang": "erl", "fennel": "fnl", "fish": "fish",
    "form": "frm prc", "fortran": "f03 f08 f90 f95", "fsharp": "fs fsi fsx", "gdscript": "gd", "gleam": "gleam", "glsl": "frag glsl vert", "go": "go", "graphql": "gql graphql", "groovy": "gradle groovy", "hare": "ha", "haskell": "hs",
    "hcl": "hcl tf", "html": "htm html", "ini": "cfg conf ini", "janet": "janet", "java": "java", "javascript": "js jsx", "json": "json", "json5": "json5", "jsonnet": "jsonnet libsonnet", "julia": "jl", "just": "just", "kdl": "kdl",
    "kotlin": "kt kts", "lean": "lean", "liquid": "liquid", "lua": "lua", "luau": "luau", "magma": "mag magma", "makefile": "mk", "markdown": "md mdx", "matlab": "m matlab mlx", "meson": "meson", "move": "move", "nim": "nim nims nimble",
    "nix": "nix", "objectivec": "mm", "ocaml": "ml mli", "odin": "odin", "pascal": "pas pp lpr", "perl": "pl pm", "php": "php", "protobuf": "proto", "python": "py", "r": "r", "ruby": "gemspec rake rb", "rust": "rs", "scala": "sc scala",
    "scss": "scss", "sql": "sql", "starlark": "star bzl", "svelte": "svelte", "swift": "swift", "toml": "toml", "tsx": "tsx", "typescript": "ts", "verilog": "sv v", "vimscript": "vim vimrc", "vue": "vue", "wolfram": "wl wls",
    "xml": "xml xsd xsl svg", "yaml": "yaml yml", "zig": "zig",
}
# Languages by whole file name.
FILE_NAMES = {
    "CMakeLists.txt": "cmake", "Dockerfile": "dockerfile", "GNUmakefile": "makefile", "Makefile": "makefile", "makefile": "makefile", "meson.build": "meson", "meson.options": "meson", "meson_options.txt": "meson",
    "kustomization.yaml": "kustomize", "kustomization.yml": "kustomize", ".vimrc": "vimscript", "Justfile": "just", "justfile": "just", "BUILD": "starlark", "BUILD.bazel": "starlark", "WORKSPACE": "starlark", "WORKSPACE.bazel": "starlark",
}
LANGUAGE_OF = {ext: language for language, exts in EXTENSIONS.items() for ext in exts.split()}

# Folders that no repository walk enters.
EXCLUDED_FOLDERS = (
    ".git .hg .svn node_modules bower_components .angular .next .nuxt .svelte-kit __pycache__ .pytest_cache .mypy_cache .venv .gradle .idea .vs .cache .parcel-cache .turbo .nyc_output .docusaurus .terraform .serverless .aws-sam cdk.out .dart_tool .pub-cache Pods DerivedData .bundle"
).split()

# Names by which programs start.
BOOTSTRAP_NAMES = ("main", "bootstrap", "init", "start", "createserver", "app", "run")

# Layers of Spring symbols, by annotation, by the end of the name and by a folder of the path.
SPRING_ANNOTATIONS = (("controller", ("RestController", "Controller")), ("service", ("Service",)), ("repository", ("Repository",)), ("entity", ("Entity",)), ("config", ("Configuration", "Component")))
SPRING_SUFFIXES = (("controller", ("controller", "resource")), ("service", ("service", "serviceimpl")), ("repository", ("repository", "repo", "dao")), ("dto", ("dto", "request", "response")), ("entity", ("entity",)), ("validator", ("validator",)), ("model", ("model",)))
SPRING_FOLDERS = (("controller", ("/controller/", "/api/", "/rest/")), ("service", ("/service/",)), ("repository", ("/repository/", "/repo/", "/dao/")), ("dto", ("/dto/",)), ("entity", ("/entity/", "/domain/")), ("model", ("/model/",)))
# Layers of Go symbols, by a folder of the path and by the end of the name.
GO_FOLDERS = (
    ("controller", ("/handler/", "/handlers/", "/api/", "/rest/")), ("service", ("/service/", "/services/", "/usecase/")), ("repository", ("/repo/", "/repository/", "/store/", "/dao/", "/persistence/")),
    ("model", ("/model/", "/models/", "/entity/", "/domain/", "/dto/")), ("middleware", ("/middleware/", "/interceptor/")), ("config", ("/config/", "/cfg/")), ("entrypoint", ("/cmd/",)),
)
GO_SUFFIXES = (("controller", ("handler", "controller", "resource")), ("service", ("service", "svc", "usecase")), ("repository", ("repo", "repository", "store", "dao")), ("model", ("model", "dto", "entity")), ("middleware", ("middleware",)))
# Frameworks by a part of a Go import path, and the first parts of the standard library's paths.
GO_FRAMEWORKS = (("gin", ("gin-gonic/gin",)), ("echo", ("labstack/echo",)), ("chi", ("go-chi/chi",)), ("fiber", ("gofiber/fiber",)), ("gorilla", ("gorilla/mux",)), ("gokit", ("go-kit/kit",)), ("ginkgo", ("onsi/ginkgo", "onsi/gomega")))
GO_STANDARD = (
    "fmt net os io log sync time math sort strings strconv bytes errors context encoding crypto database html path regexp testing reflect runtime syscall unicode bufio archive compress container debug embed expvar flag go hash image index internal maps mime plugin slices text unsafe"
).split()

# Words that start a branch, and operators that add one.
BRANCH_WORDS, BRANCH_OPERATORS = ("if ", "while ", "for ", "case ", "catch ", "except "), ("&&", "||", "?")
