"""Word lists and tables that results depend on. All are fixed values."""

# Stop-words, Portuguese and English.
STOP_WORDS_PT = """
a ao aos as com da das de do dos e em
eu já lhe me meu minha na nas no nos o
os para pela pelo por que se seu são sua
te tem tenho ter um uma uns vai à é há
isso isto mais mas muito não ou ser como
quando quais qual quem quero ver lista todos
todas algum cada esse essa esses
""".split()
STOP_WORDS_EN = """
a an and are as at be been but by can
could did do does for from had has have he
her him his how if in into is it its
may me might must my not of on or our
shall she should so some than that the their
them then there these they this those to too
us very was we were what when where which
who whom why will with would you your
""".split()
STOP_WORDS = sorted({*STOP_WORDS_PT, *STOP_WORDS_EN})

# Words that refer to one's own content.
LOCAL_WORDS = """
meu minha meus minhas nosso nossa my our mine
obsidian vault notas notes repo repositório repository projeto project
ficheiro ficheiros file files código code script scripts
configuração config setup documentos documents docs indexado indexed local
""".split()

# Words that ask for relations or structure.
GRAPH_WORDS = """
depende dependência dependências depends dependency
chama chamada calls called importa imports importação
fluxo flow pipeline cadeia chain
arquitectura arquitetura architecture structure estrutura
impacto impact afeta affects
relação relações relation relations relationship
componente componentes component components
módulo módulos module modules
vizinhos neighbors neighbour comunidade community
grafo graph upstream downstream montante jusante
""".split()

# Phrases that ask for relations or structure.
GRAPH_PHRASES = (
    "como funciona", "como é que", "o que chama", "quem chama",
    "o que depende", "quem depende", "qual o fluxo", "qual é o fluxo",
    "que relação", "como se liga", "como interage",
    "o que acontece se mudar", "impacto de alterar",
    "how does", "what calls", "what depends", "call chain", "call flow",
    "depends on", "used by", "calls to",
)

# Sections that only navigate.
NAVIGATION_SECTIONS = ("Ficheiros", "Navegação", "Índice", "Navigation", "Files", "Conteúdo")

# Which sources each context mode uses (notes, code, graph).
MODE_SOURCES = {
    "NO_CONTEXT": (False, False, False),
    "RAG_ONLY": (True, True, False),
    "GRAPH_ONLY": (False, False, True),
    "RAG_AND_GRAPH": (True, True, True),
    "CLARIFY": (True, True, False),
}

# Relations worth telling.
TOLD_RELATIONS = ("calls", "imports_from", "uses")

# What a part of a file's path says about it.
PATH_TAGS = (
    ("tests/", "testing"), ("test_", "testing"), ("pipeline/chunk", "chunking"), ("pipeline/embed", "embedding"),
    ("pipeline/search", "search"), ("pipeline/agents", "agents"), ("pipeline/config", "config"), ("pipeline/models", "models"),
    ("pipeline/main", "pipeline-core"), ("pipeline/utils", "utils"), ("pipeline/logger", "logging"), ("pipeline/catalog", "catalog"),
    ("gpu_check", "gpu"), ("config", "config"),
)

# Directories, files and suffixes of a repository that are not indexed, and the suffixes that are.
SKIPPED_DIRS = """
.git .venv venv __pycache__ .mypy_cache .pytest_cache .ruff_cache node_modules dist build .eggs *.egg-info
logs models output rag input graphify-out data site-packages source
""".split()
SKIPPED_FILES = ".gitignore .env .env.example Makefile compose.yaml docker-compose.yaml docker-compose.yml".split()
BINARY_SUFFIXES = ".pyc .pyd .so .dylib .dll .png .jpg .jpeg .gif .ico .svg .zip .tar .gz .pkl .npy .npz .faiss .index .sqlite .db".split()
DOC_SUFFIXES = ".md .mdx .txt .rst .yaml .yml .toml .sh .env".split()
