"""Virtual files with the manifests that they must give: (path, content, type, has_dependencies, raw texts)."""

TRIPLE = '"' * 3
CASES = {
    "requirements": ("requirements.txt", "requests>=2.31\n# note\nuvicorn[standard]>=0.30 ; python_version >= \"3.11\"\n--index-url https://x\n-c c.txt\n", "python-requirements", True, ["requests>=2.31", 'uvicorn[standard]>=0.30 ; python_version >= "3.11"']),
    "continuation": ("requirements-dev.in", "requests \\\r\n  >=2.31 \\\n\\\n  ; x\nflask\\", "python-requirements", True, ["requests >=2.31 ; x", "flask"]),
    "directives": ("requirements.txt", "--hash=sha256:1\n-c\n", "python-requirements", False, []),
    "odd options": ("requirements.txt", "-r\n-e .\n-rfile.txt\n", "python-requirements", True, ["-r", "-e .", "-rfile.txt"]),
    "requirements folder": ("a/requirements/base.txt", "x==1\n", "python-requirements-dir", True, ["x==1"]),
    "uv": ("uv.lock", 'version = 1\n[[package]]\nname = "requests"\nversion = "2.32.3"\n[[package]]\nname = "me"\nversion = "0"\nsource = { editable = "." }\n[[package]]\nname = "lib"\nsource = { path = "../lib" }\n[[package]]\nname = "v"\nversion = "1"\nsource = { virtual = "." }\n', "python-uv", True, ["requests==2.32.3", "lib"]),
    "uv empty": ("uv.lock", "version = 1\n", "python-uv", False, []),
    "poetry": ("poetry.lock", '[[package]]\nname = "requests"\nversion = "2.32.3"\n[[package]]\nname = "requests"\nversion = "2.32.3"\n[[package]]\nname = "lib"\nversion = "1"\n[package.source]\ntype = "git"\nurl = "https://g/x"\nreference = "main"\n[[package]]\nname = "self"\nversion = "1"\n[package.source]\ntype = "directory"\nurl = "."\n[metadata]\nlock-version = "2.0"\n', "python-poetry-lock", True, ["requests==2.32.3", "lib"]),
    "poetry metadata": ("poetry.lock", '[metadata]\nlock-version = "2.0"\n', "python-poetry-lock", False, []),
    "pipfile lock": ("Pipfile.lock", '{"_meta": {}, "default": {"requests": {"version": "==2.32.3"}, "bare": {}}, "develop": {"pytest": {"version": "==8.3.3"}}}', "python-pipfile-lock", True, ["bare", "requests==2.32.3", "pytest==8.3.3"]),
    "pdm": ("pdm.lock", '[[package]]\nname = "x"\n', "python-pdm-lock", True, []),
    "conda lock": ("conda-lock.yml", "version: 1\npackage: []\n", "python-conda-lock", False, []),
    "conda": ("environment.yml", "name: x\ndependencies: []\n", "python-conda-environment", None, []),
    "pyproject": (
        "pyproject.toml",
        '[build-system]\nrequires = ["setuptools>=68"]\n[project]\ndependencies = ["requests>=2.31", "httpx[http2]>=0.27"]\n[project.optional-dependencies]\ndocs = ["mkdocs"]\ndev = ["pytest>=8"]\n[dependency-groups]\nlint = ["ruff", {include-group = "x"}]\n[tool.poetry.dependencies]\npython = "^3.11"\nfastapi = "^0.1"\nx = { version = "1", optional = true }\n',
        "python-pyproject", True, ["setuptools>=68", "requests>=2.31", "httpx[http2]>=0.27", "pytest>=8", "mkdocs", "ruff", 'fastapi = "^0.1"', 'x = { optional = true, version = "1" }'],
    ),
    "pipfile": ("Pipfile", '[[source]]\nurl = "u"\n[docs]\nsphinx = "*"\n[dev-packages]\npytest = "*"\n[packages]\nrequests = { version = "==1", extras = ["a"] }\n[requires]\npython_version = "3"\n', "python-pipfile", True, ['requests = { extras = ["a"], version = "==1" }', 'pytest = "*"', 'sphinx = "*"']),
    "pipfile metadata": ("Pipfile", '[requires]\npython_version = "3"\n', None, None, []),
    "setup.py": ("setup.py", "from setuptools import setup\nsetup(\n  name='x',  # c\n  install_requires=['a>=1', \"b\"],\n  extras_require={'dev': ['c', 'a>=1']},\n)\n", "python-setup-py", True, ["a>=1", "b", "c"]),
    "setup.py computed": ("setup.py", "import setuptools\nsetuptools.setup(install_requires=read())\n", "python-setup-py", None, []),
    "setup.py two names": ("setup.py", "from setuptools import setup, find_packages\nsetup(install_requires=['a'])\n", None, None, []),
    "setup.cfg": ("setup.cfg", "[options]\ninstall_requires =\n    requests>=2.31\n    # c\n    urllib3<3 ; x\n    file: y\n[options.extras_require]\ndev =\n    pytest>=8\n", "python-setup-cfg", True, ["requests>=2.31", "urllib3<3", "pytest>=8"]),
    "setup.cfg inline": ("setup.cfg", "[options]\ninstall_requires = a, b\n", "python-setup-cfg", False, []),
    "setup.cfg without": ("setup.cfg", "[metadata]\nname = x\n", None, None, []),
    "package.json": ("package.json", '{"dependencies": {}, "devDependencies": {"a": "1"}}', "js", True, []),
    "package.json none": ("package.json", '{"dependencies": {}}', "js", False, []),
    "package.json zero": ("package.json", '{"dependencies": 0}', "js", True, []),
    "npm 1": ("package-lock.json", '{"lockfileVersion": 1, "dependencies": {"b": {"version": "1", "dependencies": {"a": {"version": "3"}}}, "a": {"version": "2"}, "c": {}}}', "js-npm-lock", True, ["a@2", "b@1", "a@3", "c"]),
    "npm 3": ("npm-shrinkwrap.json", '{"lockfileVersion": 3, "packages": {"": {"dependencies": {"left-pad": "1"}, "devDependencies": {"@types/node": "x"}}, "node_modules/left-pad": {"version": "1.3.0"}, "node_modules/@types/node": {"version": "20.12.7"}, "node_modules/x/node_modules/left-pad": {"version": "9"}, "packages/a": {"version": "1"}}}', "js-npm-shrinkwrap", True, ["@types/node@20.12.7", "left-pad@1.3.0", "left-pad@9"]),
    "npm root": ("package-lock.json", '{"lockfileVersion": 3, "packages": {"": {"dependencies": {"react": "1"}, "optionalDependencies": {"a": "1", "react": "2"}}}}', "js-npm-lock", True, ["react", "a"]),
    "npm 9": ("package-lock.json", '{"lockfileVersion": 9}', None, None, []),
    "yarn 1": ("yarn.lock", '# THIS IS AN AUTOGENERATED FILE. DO NOT EDIT THIS FILE DIRECTLY.\n# yarn lockfile v1\n\n\nleft-pad@^1.3.0, left-pad@~1:\n  version "1.3.0"\n  dependencies:\n    x "1"\n\n"@types/node@*":\n  version "20"\nbare@1:\n\n', "js-yarn", True, ["left-pad@1.3.0", "@types/node@20", "bare"]),
    "yarn modern": ("yarn.lock", '# note\n\n__metadata:\n  version: 8\n\n"react@npm:^18":\n  version: 18.3.1\n  resolution: "react@npm:18.3.1"\n\n"@babel/x@npm:7, @babel/x@npm:8":\n  version: 7.27.1\n', "js-yarn", True, ["@babel/x@7.27.1", "react@18.3.1"]),
    "yarn neither": ("yarn.lock", "x\n", None, None, []),
    "pnpm": ("pnpm-lock.yaml", "lockfileVersion: '9.0'\nimporters:\n  .:\n    dependencies:\n      react:\n        specifier: ^18.3.1\n        version: 18.3.1\n    devDependencies:\n      only:\n        specifier: ^2\n  sub:\n    dependencies:\n      no:\n        version: 1\npackages:\n  react@18.3.1:\n    x: 1\n  loose-envify@1.4.0(react@18):\n    x: 1\n  '@a/b@2.0':\n    x: 1\n", "js-pnpm-lock", True, ["react@18.3.1", "only@^2", "@a/b@2.0", "loose-envify@1.4.0"]),
    "pnpm 5": ("pnpm-lock.yaml", "lockfileVersion: 5.4\ndependencies:\n  react: 18.10\npackages:\n  /@types/node/20.0.0:\n    dev: true\n", "js-pnpm-lock", True, ["react@18.10", "@types/node@20.0.0"]),
    "pom": ("pom.xml", '<project xmlns="urn:x"><dependencies><dependency/></dependencies></project>', "java", True, []),
    "pom managed": ("pom.xml", "<project><dependencyManagement><dependencies><dependency/></dependencies></dependencyManagement></project>", "java", False, []),
    "pom empty": ("pom.xml", "", "java", False, []),
    "composer": ("composer.lock", '{"packages": [{"name": "z/z", "version": "2"}, {"name": "monolog/monolog", "version": "3.6.0", "type": "library"}], "packages-dev": [{"name": "z/z", "version": "2"}, {"name": "z/z", "version": "2"}]}', "php-composer-lock", True, ["monolog/monolog@3.6.0", "z/z@2", "z/z@2"]),
    "cargo lock": ("Cargo.lock", 'version = 3\n[[package]]\nname = "serde"\nversion = "1.0.217"\nsource = "registry+https://r"\nchecksum = "abc"\n[[package]]\nname = "g"\nversion = "1"\nsource = "git+https://g#f"\n', "rust-cargo-lock", True, ["serde@1.0.217", "g@1"]),
    "cargo lock old": ("Cargo.lock", '[[package]]\nname = "serde"\nversion = "1"\n', None, None, []),
    "cargo": ("Cargo.toml", '[package]\nname = "x"\n[target.x.dependencies]\na = "1"\n', "rust-cargo", True, []),
    "cargo none": ("Cargo.toml", '[dependencies]\n', "rust-cargo", False, []),
    "go": ("go.mod", 'module x\n\ngo 1.22\n\nrequire github.com/a/b v1.9.0 // indirect\nrequire (\n\tgithub.com/c/d v2.0.0+incompatible\n\t// note\n)\nreplace (\n\tx => y v1\n)\n', "go-mod", True, ["github.com/a/b", "github.com/c/d"]),
    "go none": ("go.mod", "module x\n", "go-mod", False, []),
    "gem": ("x/demo.gemspec", "x", "ruby-gemspec", None, []),
    "terraform lock": ("a/.terraform.lock.hcl", "x", "terraform-lock", None, []),
    "unity": ("Packages/manifest.json", '{"dependencies": {"a": "1"}}', "unity-packages-manifest", True, []),
    "unity deep": ("x/Packages/manifest.json", '{"dependencies": {"a": "1"}}', None, None, []),
    "banner": ("jq.js", "/*! jQuery v3.7.1 | (c) */\nx", "js-banner-block-start", True, ["jQuery@3.7.1"]),
    "banner plain": ("a.js", "/* Bootstrap 5.3.3 */", "js-banner-plain-block-start", True, ["Bootstrap@5.3.3"]),
    "banner lines": ("b.js", "/*!\n * DOMPurify 3.0.8\n * more\n */", "js-banner-multiline-preserved", True, ["DOMPurify@3.0.8"]),
    "banner comment": ("c.js", "\n//! mustache.js 4.2.0\n", "js-banner-line-comment", True, ["mustache.js@4.2.0"]),
    "banner tags": ("d.js", "/*! package: htmx.org version: 2.0.4 */", "js-banner-version-tagged", True, ["htmx.org@2.0.4"]),
    "js": ("e.js", "x = 1", None, None, []),
    "html": ("index.html", "<script src='https://cdn/a.js'></script><script src=\"/l.js\"></script>\n<script type=importmap>{\"imports\": {\"a\": \"https://x/a.js\", \"b\": \"./b.js\"}}</script><script type=\"module\">import x from 'https://y/z.js';\nimport \"https://w/v.js\"</script>", "html-external-scripts", True, ["https://cdn/a.js", "https://x/a.js", "https://y/z.js", "https://w/v.js"]),
    "html none": ("index.htm", "<script>1</script>", None, None, []),
    "terraform": ("m.tf", 'variable "x" {}\nresource "aws_glue_job" "a" {\n  name = "x"\n  default_arguments = {\n    "--job-language" = "python" # c\n    "--additional-python-modules" = "a,b"\n  }\n}\n', "terraform.aws_glue_job.python", None, []),
    "terraform variable": ("m.tf", 'resource "aws_glue_job" "a" {\n  default_arguments = {\n    "--job-language" = "python"\n    "--additional-python-modules" = var.x\n  }\n}\n', None, None, []),
    "typescript": ("j.ts", 'import * as glue from "aws-cdk-lib/aws-glue";\nconst mods = "pandas==2.2.1, numpy";\nconst props = { defaultArguments: { "--job-language": "python", "--additional-python-modules": mods } };\nnew glue.CfnJob(this, "x", props);\n', "typescript.cdk.aws_glue_job.python", True, ["pandas==2.2.1", "numpy"]),
    "typescript computed": ("j.ts", 'import { CfnJob as J } from "aws-cdk-lib/aws-glue";\nnew J(this, "x", { defaultArguments: { "--job-language": "python", "--additional-python-modules": f() } });\n', "typescript.cdk.aws_glue_job.python", None, []),
    "typescript single quotes": ("j.ts", "import { CfnJob } from 'aws-cdk-lib/aws-glue';\nnew CfnJob(this, 'x', { defaultArguments: { '--job-language': 'python' } });\n", None, None, []),
    "python cdk": ("j.py", 'from aws_cdk import aws_glue as glue\nMODS = "pandas==2.2.1,numpy"\nglue.CfnJob(self, "x", default_arguments={"--job-language": "python", "--additional-python-modules": MODS})\n', "python.cdk.aws_glue_job.python", True, ["pandas==2.2.1", "numpy"]),
    "python cdk itself": ("j.py", 'import aws_cdk.aws_glue\nx = x\naws_cdk.aws_glue.CfnJob(self, "x", default_arguments=x)\n', None, None, []),
    "bad json": ("package.json", "{", "js", None, []),
    "array json": ("bower.json", "[]", "js-bower", None, []),
    "bad toml": ("uv.lock", "version = ", "python-uv", None, []),
    "bad yaml": ("Chart.yaml", "a: [", "helm-chart", None, []),
    "bad xml": ("pom.xml", "<project><a>", "java", None, []),
    "bad xml after a hit": ("pom.xml", "<project><dependencies><dependency/><", "java", True, []),
    "bad terraform": ("m.tf", 'resource "x" {\n', "terraform.aws_glue_job.python", None, []),
    "unknown": ("notes.md", "x", None, None, []),
    "ignored": ("node_modules/package.json", "{}", None, None, []),
}
