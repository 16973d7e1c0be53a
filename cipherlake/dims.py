"""Reference tables: fixed values as Python literals, turned into DataFrames for Spark and into VALUES for the SQL oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Severities (name, weight, rank), languages and what the scanner looks for.
SEVERITIES = [("CRITICAL", 25, 0), ("HIGH", 10, 1), ("MEDIUM", 3, 2), ("LOW", 1, 3), ("INFO", 0, 4)]
EXTENSIONS = [(".py", "Python"), (".java", "Java"), (".go", "Go"), (".js", "JavaScript"), (".ts", "JavaScript"), (".mjs", "JavaScript"), (".c", "C/C++"), (".cpp", "C/C++"), (".cc", "C/C++"), (".h", "C/C++"), (".hpp", "C/C++"), (".rs", "Rust"), (".conf", "Config"), (".cfg", "Config")]
SKIP_DIRS = [".git", "node_modules", "__pycache__", ".venv", "venv", "build", "dist", ".tox", ".mypy_cache", ".pytest_cache"]
PATTERNS = [
    ("Python", r"rsa\.generate_private_key|RSA\.generate|PKCS1_v15|PKCS1_OAEP", "RSA", "CRITICAL", "key_exchange"),
    ("Python", r"RSAPrivateKey|RSAPublicKey|rsa_private_key|rsa_public_key", "RSA", "HIGH", "signature"),
    ("Python", r"ec\.generate_private_key|ECDSA|ec\.SECP256R1|ec\.SECP384R1", "ECDSA", "CRITICAL", "signature"),
    ("Python", r"ECDH|ec\.ECDH|derive.*shared.*key", "ECDH", "CRITICAL", "key_exchange"),
    ("Python", r"ed25519|Ed25519", "Ed25519", "HIGH", "signature"),
    ("Python", r"dh\.generate_parameters|DHParameters|DiffieHellman", "DH", "CRITICAL", "key_exchange"),
    ("Python", r"AES\.new\(.{0,30}16\)|algorithms\.AES\(.{0,30}16\)|aes[_-]128|AES128", "AES-128", "MEDIUM", "symmetric"),
    ("Python", r"\bDES\b|3DES|TripleDES|DES3", "3DES", "HIGH", "symmetric"),
    ("Python", r"Blowfish|blowfish|BF_", "Blowfish", "HIGH", "symmetric"),
    ("Python", r"\bRC4\b|ARC4|rc4", "RC4", "HIGH", "symmetric"),
    ("Python", r"hashlib\.sha1|SHA1|sha1\b", "SHA-1", "MEDIUM", "hash"),
    ("Python", r"hashlib\.md5|MD5|md5\b", "MD5", "HIGH", "hash"),
    ("Java", r"KeyPairGenerator\.getInstance\s*\(\s*\"RSA\"", "RSA", "CRITICAL", "key_exchange"),
    ("Java", r"Cipher\.getInstance\s*\(\s*\"RSA", "RSA", "CRITICAL", "key_exchange"),
    ("Java", r"Signature\.getInstance\s*\(.*(RSA|ECDSA|EdDSA|DSA)", "RSA/ECDSA", "HIGH", "signature"),
    ("Java", r"KeyAgreement\.getInstance\s*\(\s*\"(ECDH|DH)\"", "ECDH/DH", "CRITICAL", "key_exchange"),
    ("Java", r"KeyPairGenerator\.getInstance\s*\(\s*\"(EC|DSA)\"", "ECDSA/DSA", "CRITICAL", "signature"),
    ("Java", r"MessageDigest\.getInstance\s*\(\s*\"(SHA-1|MD5)\"", "SHA-1/MD5", "MEDIUM", "hash"),
    ("Go", r"crypto/rsa|rsa\.GenerateKey", "RSA", "CRITICAL", "key_exchange"),
    ("Go", r"crypto/ecdsa|ecdsa\.GenerateKey|ecdsa\.Sign", "ECDSA", "CRITICAL", "signature"),
    ("Go", r"crypto/elliptic|elliptic\.P256|elliptic\.P384", "ECDH", "CRITICAL", "key_exchange"),
    ("Go", r"crypto/dsa", "DSA", "CRITICAL", "signature"),
    ("Go", r"crypto/des|des\.NewCipher", "3DES", "HIGH", "symmetric"),
    ("JavaScript", r"crypto\.createSign|crypto\.createVerify", "RSA/ECDSA", "HIGH", "signature"),
    ("JavaScript", r"crypto\.generateKeyPair\s*\(\s*['\"]rsa['\"]", "RSA", "CRITICAL", "key_exchange"),
    ("JavaScript", r"crypto\.createDiffieHellman|crypto\.createECDH", "DH/ECDH", "CRITICAL", "key_exchange"),
    ("JavaScript", r"node-rsa|node-forge.*rsa", "RSA", "CRITICAL", "dependency"),
    ("Config", r"ssl_ciphers.*(?:RC4|DES|3DES|EXPORT)", "Weak cipher", "HIGH", "protocol"),
    ("Config", r"\bRC4\b", "RC4", "HIGH", "symmetric"),
    ("Config", r"SSLProtocol.*(?:SSLv3|TLSv1\b|TLSv1\.0|TLSv1\.1)", "Old TLS", "HIGH", "protocol"),
    ("Config", r"ssl_protocols.*(?:TLSv1\b|TLSv1\.0|TLSv1\.1)", "Old TLS", "HIGH", "protocol"),
    ("C/C++", r"RSA_generate_key|RSA_new|EVP_PKEY_CTX_new_id\s*\(\s*EVP_PKEY_RSA", "RSA", "CRITICAL", "key_exchange"),
    ("C/C++", r"EC_KEY_new|EC_KEY_generate_key|EVP_PKEY_CTX_new_id\s*\(\s*EVP_PKEY_EC", "ECDSA", "CRITICAL", "signature"),
    ("C/C++", r"DH_generate_parameters|EVP_PKEY_CTX_new_id\s*\(\s*EVP_PKEY_DH", "DH", "CRITICAL", "key_exchange"),
    ("C/C++", r"EVP_des_|DES_set_key|DES_ecb_encrypt", "3DES", "HIGH", "symmetric"),
    ("C/C++", r"EVP_sha1\b|SHA1_Init|SHA1_Update", "SHA-1", "MEDIUM", "hash"),
    ("C/C++", r"EVP_md5\b|MD5_Init|MD5_Update", "MD5", "HIGH", "hash"),
    ("C/C++", r"EVP_aes_128_|AES_set_encrypt_key\(.{0,20}16\)", "AES-128", "MEDIUM", "symmetric"),
    ("Rust", r"use\s+rsa::|RsaPrivateKey|RsaPublicKey", "RSA", "CRITICAL", "key_exchange"),
    ("Rust", r"use\s+p256::|use\s+k256::|EcdsaSigningKey", "ECDSA", "CRITICAL", "signature"),
    ("Rust", r"use\s+sha1::|Sha1::new", "SHA-1", "MEDIUM", "hash"),
]
#: Built-in rules: id, severity, category, algorithm, pattern, languages.
RULES = [
    ("pqc-jwt-rsa", "HIGH", "signature", "RSA", r"[\"']RS256[\"']|[\"']RS384[\"']|[\"']RS512[\"']", "python,java,javascript,typescript,go"),
    ("pqc-jwt-ecdsa", "HIGH", "signature", "ECDSA", r"[\"']ES256[\"']|[\"']ES384[\"']|[\"']ES512[\"']", "python,java,javascript,typescript,go"),
    ("pqc-ssh-rsa", "HIGH", "key_exchange", "RSA", r"ssh-rsa|id_rsa", "python,config,yaml"),
    ("pqc-hardcoded-key", "CRITICAL", "key_exchange", "Hardcoded Key", r"(?:private_key|secret_key|api_key)\s*=\s*[\"'][A-Za-z0-9+/=]{20,}[\"']", "python,java,javascript,typescript,go,ruby"),
]
#: Replacement of each algorithm.
REPLACEMENTS = [("RSA", "ML-KEM-768 or ML-DSA-65"), ("ECDSA", "ML-DSA-65"), ("ECDH", "ML-KEM-768"), ("EdDSA", "ML-DSA-65"), ("Ed25519", "ML-DSA-44"), ("Ed448", "ML-DSA-65"), ("X25519", "ML-KEM-768"), ("X448", "ML-KEM-768"), ("DH", "ML-KEM-768"), ("DSA", "ML-DSA-65"), ("AES-128", "AES-256"), ("SHA-1", "SHA-256 or SHA-3"), ("MD5", "SHA-256 or SHA-3"), ("3DES", "AES-256-GCM"), ("RC4", "AES-256-GCM"), ("Blowfish", "AES-256-GCM")]
#: Base risk of an algorithm and risk of a key size.
BASE_RISK = [("RSA", 0.95), ("DH", 0.95), ("DSA", 0.93), ("ECDSA", 0.90), ("ECDH", 0.90), ("Ed25519", 0.88), ("Ed448", 0.88), ("X25519", 0.88), ("X448", 0.88), ("AES-128", 0.25), ("AES-256", 0.05), ("SHA-1", 0.45), ("MD5", 0.55), ("MD4", 0.60), ("3DES", 0.65), ("RC4", 0.75), ("Blowfish", 0.55), ("IDEA", 0.50), ("CAST5", 0.50), ("DES", 0.80)]
SIZE_RISK = [(512, 1.0), (768, 0.98), (1024, 0.95), (2048, 0.80), (3072, 0.70), (4096, 0.60), (8192, 0.40), (224, 0.85), (384, 0.70), (521, 0.60), (128, 0.25), (192, 0.10), (256, 0.05)]
SENSITIVITY = {"public": 0.1, "internal": 0.4, "confidential": 0.7, "restricted": 1.0}
EXPOSURE = {"isolated": 0.1, "internal": 0.3, "internet": 0.8, "critical_infra": 1.0}
#: Algorithms that Shor's and Grover's methods break or weaken.
SHOR = ["RSA", "ECDSA", "ECDH", "DH", "DSA", "EdDSA", "Ed25519", "Ed448", "X25519", "X448", "RSA/ECDSA", "ECDSA/DSA", "ECDH/DH", "DH/ECDH"]
# Deadlines of CNSA 2.0, and the frameworks' rows (framework, algorithm, status, deadline key or year).
DEADLINES = [("software_signing", "2030-12-31"), ("web_services", "2033-12-31"), ("networking", "2030-12-31"), ("all_nss", "2033-12-31")]
COMPLIANCE = [
    ("CNSA 2.0", "RSA", "NON-COMPLIANT", "software_signing"),
    ("CNSA 2.0", "ECDSA", "NON-COMPLIANT", "all_nss"),
    ("CNSA 2.0", "ECDH", "NON-COMPLIANT", "networking"),
    ("CNSA 2.0", "Ed25519", "NON-COMPLIANT", "all_nss"),
    ("CNSA 2.0", "DH", "NON-COMPLIANT", "networking"),
    ("CNSA 2.0", "DSA", "NON-COMPLIANT", "software_signing"),
    ("CNSA 2.0", "AES-128", "NON-COMPLIANT", "software_signing"),
    ("CNSA 2.0", "AES-256", "COMPLIANT", None),
    ("CNSA 2.0", "SHA-1", "NON-COMPLIANT", "software_signing"),
    ("CNSA 2.0", "SHA-256", "DEPRECATED", "all_nss"),
    ("CNSA 2.0", "MD5", "NON-COMPLIANT", "software_signing"),
    ("CNSA 2.0", "3DES", "NON-COMPLIANT", "software_signing"),
    ("CNSA 2.0", "RC4", "NON-COMPLIANT", "software_signing"),
    ("CNSA 2.0", "Blowfish", "NON-COMPLIANT", "software_signing"),
    ("NIST IR 8547", "RSA", "DEPRECATED", "2030"),
    ("NIST IR 8547", "ECDSA", "DEPRECATED", "2030"),
    ("NIST IR 8547", "ECDH", "DEPRECATED", "2030"),
    ("NIST IR 8547", "Ed25519", "DEPRECATED", "2035"),
    ("NIST IR 8547", "DH", "DEPRECATED", "2030"),
    ("NIST IR 8547", "DSA", "NON-COMPLIANT", "2023"),
    ("NIST IR 8547", "AES-128", "DEPRECATED", "2035"),
    ("NIST IR 8547", "AES-256", "COMPLIANT", None),
    ("NIST IR 8547", "SHA-1", "NON-COMPLIANT", "2023"),
    ("NIST IR 8547", "SHA-256", "COMPLIANT", None),
    ("NIST IR 8547", "MD5", "NON-COMPLIANT", "2010"),
    ("NIST IR 8547", "3DES", "NON-COMPLIANT", "2023"),
    ("NIST IR 8547", "RC4", "NON-COMPLIANT", "2015"),
    ("NIST IR 8547", "Blowfish", "NON-COMPLIANT", "2023"),
    ("PCI DSS 4.0", "RSA", "DEPRECATED", "2030"),
    ("PCI DSS 4.0", "ECDSA", "COMPLIANT", None),
    ("PCI DSS 4.0", "ECDH", "COMPLIANT", None),
    ("PCI DSS 4.0", "Ed25519", "COMPLIANT", None),
    ("PCI DSS 4.0", "DH", "DEPRECATED", "2025"),
    ("PCI DSS 4.0", "DSA", "NON-COMPLIANT", "2023"),
    ("PCI DSS 4.0", "AES-128", "COMPLIANT", None),
    ("PCI DSS 4.0", "AES-256", "COMPLIANT", None),
    ("PCI DSS 4.0", "SHA-1", "NON-COMPLIANT", "2023"),
    ("PCI DSS 4.0", "SHA-256", "COMPLIANT", None),
    ("PCI DSS 4.0", "MD5", "NON-COMPLIANT", "2010"),
    ("PCI DSS 4.0", "3DES", "NON-COMPLIANT", "2023"),
    ("PCI DSS 4.0", "RC4", "NON-COMPLIANT", "2015"),
    ("PCI DSS 4.0", "Blowfish", "NON-COMPLIANT", "2023"),
]
#: Migration effort (algorithm, hours, kind).
EFFORT = [("MD5", 0.5, "DROP_IN"), ("SHA-1", 0.5, "DROP_IN"), ("AES-128", 1.0, "DROP_IN"), ("3DES", 2.0, "API_CHANGE"), ("RC4", 2.0, "API_CHANGE"), ("Blowfish", 2.0, "API_CHANGE"), ("Ed25519", 5.0, "ARCHITECTURAL"), ("ECDSA", 6.0, "ARCHITECTURAL"), ("ECDH", 6.0, "ARCHITECTURAL"), ("DSA", 6.0, "ARCHITECTURAL"), ("RSA", 8.0, "ARCHITECTURAL"), ("DH", 8.0, "ARCHITECTURAL")]
# Text substitutions that fix a line (extension, algorithm, pattern, replacement); the first of an extension and algorithm that changes the text wins.
FIXES = [
    (".py", "MD5", r"hashlib\.md5\b", "hashlib.sha256"), (".py", "MD5", r"hashlib\.new\(['\"]md5['\"]\)", "hashlib.new('sha256')"), (".py", "SHA-1", r"hashlib\.sha1\b", "hashlib.sha256"), (".py", "SHA-1", r"hashlib\.new\(['\"]sha1['\"]\)", "hashlib.new('sha256')"), (".py", "3DES", r"from Crypto\.Cipher import DES\b", "from Crypto.Cipher import AES"), (".py", "3DES", r"from Crypto\.Cipher import DES3", "from Crypto.Cipher import AES"), (".py", "3DES", r"DES\.new\(", "AES.new("), (".py", "3DES", r"DES3\.new\(", "AES.new("), (".py", "Blowfish", r"from Crypto\.Cipher import Blowfish", "from Crypto.Cipher import AES"), (".py", "Blowfish", r"Blowfish\.new\(", "AES.new("), (".py", "RC4", r"from Crypto\.Cipher import ARC4", "from Crypto.Cipher import AES"),
    (".java", "MD5", r"MessageDigest\.getInstance\s*\(\s*\"MD5\"\s*\)", 'MessageDigest.getInstance("SHA-256")'), (".java", "SHA-1", r"MessageDigest\.getInstance\s*\(\s*\"SHA-1\"\s*\)", 'MessageDigest.getInstance("SHA-256")'), (".java", "3DES", r"Cipher\.getInstance\s*\(\s*\"DES[^\"]*\"\s*\)", 'Cipher.getInstance("AES/GCM/NoPadding")'), (".java", "3DES", r"Cipher\.getInstance\s*\(\s*\"DESede[^\"]*\"\s*\)", 'Cipher.getInstance("AES/GCM/NoPadding")'), (".java", "AES-ECB", r"Cipher\.getInstance\s*\(\s*\"AES/ECB/[^\"]*\"\s*\)", 'Cipher.getInstance("AES/GCM/NoPadding")'),
    (".go", "3DES", r"crypto/des", "crypto/aes"), (".go", "3DES", r"des\.NewCipher", "aes.NewCipher"), (".go", "MD5", r"crypto/md5", "crypto/sha256"), (".go", "MD5", r"md5\.New\(\)", "sha256.New()"), (".go", "SHA-1", r"crypto/sha1", "crypto/sha256"), (".go", "SHA-1", r"sha1\.New\(\)", "sha256.New()"),
    (".conf", "Old TLS", r"ssl_protocols\s+.*TLSv1\b[^.23]", "ssl_protocols TLSv1.2 TLSv1.3;"), (".conf", "SSLv3", r"SSLProtocol\s+.*SSLv3", "SSLProtocol all -SSLv3 -TLSv1 -TLSv1.1"), (".conf", "RC4", r"ssl_ciphers.*RC4", "ssl_ciphers ECDHE-ECDSA-AES256-GCM-SHA384:ECDHE-RSA-AES256-GCM-SHA384;"),
]
# Rules of SARIF output, properties of bills of materials (algorithm, primitive, family) and classical security bits.
CBOM = [("RSA", "pke", "RSA"), ("ECDSA", "signature", "EC"), ("ECDH", "ke", "EC"), ("Ed25519", "signature", "EC"), ("DH", "ke", "DH"), ("DSA", "signature", "DSA"), ("AES-128", "blockcipher", "AES"), ("SHA-1", "hash", "SHA"), ("MD5", "hash", "MD"), ("3DES", "blockcipher", "DES"), ("RC4", "streamcipher", "RC4"), ("Blowfish", "blockcipher", "Blowfish")]
CLASSICAL_BITS = [("RSA", 112), ("ECDSA", 128), ("ECDH", 128), ("Ed25519", 128), ("DH", 112), ("DSA", 112), ("AES-128", 128), ("SHA-1", 80), ("MD5", 64), ("3DES", 112), ("RC4", 0), ("Blowfish", 64)]
# Packages with cryptography (ecosystem, normalised package, risk); the maven key is a group's prefix.
PACKAGES = [
    ("pip", "cryptography", "HIGH"), ("pip", "pycryptodome", "HIGH"), ("pip", "pycryptodomex", "HIGH"), ("pip", "pyopenssl", "HIGH"), ("pip", "paramiko", "HIGH"), ("pip", "pyca/bcrypt", "MEDIUM"), ("pip", "rsa", "CRITICAL"), ("pip", "ecdsa", "CRITICAL"), ("pip", "pynacl", "HIGH"), ("pip", "jwcrypto", "HIGH"), ("pip", "pyjwt", "HIGH"), ("pip", "tls", "MEDIUM"), ("pip", "certifi", "INFO"), ("pip", "requests", "INFO"), ("pip", "boto3", "MEDIUM"), ("pip", "azure_identity", "MEDIUM"), ("pip", "google_auth", "MEDIUM"),
    ("npm", "node_rsa", "CRITICAL"), ("npm", "elliptic", "CRITICAL"), ("npm", "node_forge", "HIGH"), ("npm", "jsonwebtoken", "HIGH"), ("npm", "jose", "HIGH"), ("npm", "bcrypt", "INFO"), ("npm", "crypto_js", "MEDIUM"), ("npm", "ssh2", "HIGH"), ("npm", "tls", "MEDIUM"),
    ("maven", "org_bouncycastle", "HIGH"), ("maven", "com_google_crypto_tink", "MEDIUM"), ("maven", "javax_crypto", "HIGH"), ("maven", "io_jsonwebtoken", "HIGH"), ("maven", "org_apache_shiro", "MEDIUM"), ("maven", "com_nimbusds", "HIGH"),
    ("go", "crypto/rsa", "CRITICAL"), ("go", "crypto/ecdsa", "CRITICAL"), ("go", "crypto/elliptic", "CRITICAL"), ("go", "github_com/cloudflare/circl", "INFO"), ("go", "golang_org/x/crypto", "HIGH"),
    ("cargo", "rsa", "CRITICAL"), ("cargo", "p256", "CRITICAL"), ("cargo", "k256", "CRITICAL"), ("cargo", "ed25519_dalek", "HIGH"), ("cargo", "ring", "HIGH"), ("cargo", "rustls", "MEDIUM"), ("cargo", "pqcrypto", "INFO"),
]
# Manifest and lock files (name, format, ecosystem, whether its packages are transitive).
MANIFESTS = [
    ("requirements.txt", "requirements", "pip", False), ("requirements-dev.txt", "requirements", "pip", False), ("requirements_dev.txt", "requirements", "pip", False), ("pyproject.toml", "pyproject", "pip", False), ("Pipfile", "requirements", "pip", False), ("package.json", "package_json", "npm", False), ("pom.xml", "pom", "maven", False), ("go.mod", "go_mod", "go", False), ("Cargo.toml", "cargo_toml", "cargo", False),
    ("Pipfile.lock", "pipfile_lock", "pip", True), ("poetry.lock", "poetry_lock", "pip", True), ("package-lock.json", "package_lock", "npm", True), ("yarn.lock", "yarn_lock", "npm", True), ("Cargo.lock", "cargo_lock", "cargo", True), ("go.sum", "go_sum", "go", True),
]
# Algorithms of packages, for bills of materials (normalised package, algorithms), and the state of each algorithm.
PACKAGE_ALGORITHMS = [
    ("cryptography", "RSA,ECDSA,ECDH,Ed25519,AES,DH,DSA"), ("pycryptodome", "RSA,ECDSA,AES,DES,3DES,Blowfish,RC4"), ("pycryptodomex", "RSA,ECDSA,AES,DES,3DES,Blowfish,RC4"), ("pyopenssl", "RSA,ECDSA,DH"), ("paramiko", "RSA,ECDSA,Ed25519"), ("pynacl", "Ed25519,X25519"), ("pyjwt", "RSA,ECDSA"), ("python_jose", "RSA,ECDSA"), ("rsa", "RSA"), ("ecdsa", "ECDSA"),
    ("node_rsa", "RSA"), ("node_forge", "RSA,ECDSA,AES,3DES,DES"), ("jsonwebtoken", "RSA,ECDSA"), ("jose", "RSA,ECDSA"), ("elliptic", "ECDSA,ECDH"), ("tweetnacl", "Ed25519,X25519"), ("org_bouncycastle", "RSA,ECDSA,DH,DSA,AES,3DES"), ("com_auth0:java_jwt", "RSA,ECDSA"), ("golang_org/x/crypto", "Ed25519,X25519,ECDSA"), ("p256", "ECDSA"), ("ed25519_dalek", "Ed25519"), ("x25519_dalek", "X25519"),
]
ALGORITHM_STATES = [
    ("RSA", "vulnerable"), ("ECDSA", "vulnerable"), ("ECDH", "vulnerable"), ("Ed25519", "vulnerable"), ("Ed448", "vulnerable"), ("X25519", "vulnerable"), ("X448", "vulnerable"), ("DH", "vulnerable"), ("DSA", "vulnerable"),
    ("AES-128", "weakened"), ("AES-256", "safe"), ("SHA-1", "weakened"), ("SHA-256", "safe"), ("MD5", "broken"), ("3DES", "broken"), ("RC4", "broken"), ("Blowfish", "weakened"), ("DES", "broken"),
]
# What Shor's and Grover's methods break or weaken for the readiness grade, and the gates (gate, condition, check, threshold).
READY_SHOR = ["RSA", "ECDSA", "ECDH", "Ed25519", "DH", "DSA", "RSA/ECDSA", "ECDH/DH", "ECDSA/DSA", "DH/ECDH"]
READY_GROVER = ["AES-128", "SHA-1", "MD5", "3DES", "RC4", "Blowfish", "SHA-1/MD5", "Weak cipher", "Old TLS"]
GATES = [
    ("pqc-ready", "no_shor", "count_shor", "0"), ("pqc-ready", "grade_c", "grade_above", "D"), ("pqc-ready", "no_overdue", "cnsa_overdue", "0"),
    ("no-critical", "no_crit", "severity_count", "CRITICAL:0"),
    ("cnsa-compliant", "no_overdue", "cnsa_overdue", "0"), ("cnsa-compliant", "no_non_compliant", "cnsa_violations", "0"),
    ("migration-safe", "grade_f", "grade_above", "F"), ("migration-safe", "qars_80", "qars_below", "80"),
]

#: Our own lines of code, from which the derived corpus is dealt (language, ordinal, text).
_OWN = {
    "Python": ["total = total + price", "key = rsa.generate_private_key(public_exponent=65537, key_size=2048)", "# digest = hashlib.md5(data)", "digest = hashlib.md5(data).hexdigest()", "digest = hashlib.sha1(data)  # pqc-ignore", "name = 'uses MD5 for names'", "cipher = DES.new(key, DES.MODE_ECB)  # pqc-ignore[RSA, 3DES]", "token = jwt.encode(claims, secret, algorithm='RS256')", "sign = ec.generate_private_key(ec.SECP256R1())"],
    "Java": ["int n = list.size();", 'KeyPairGenerator g = KeyPairGenerator.getInstance("RSA");', '// Cipher c = Cipher.getInstance("RSA/ECB/PKCS1Padding");', 'MessageDigest d = MessageDigest.getInstance("MD5");', 'String s = "nothing /* here */ to see";', '/* KeyAgreement.getInstance("DH") */ int k = 0;', 'KeyAgreement a = KeyAgreement.getInstance("ECDH");'],
    "Go": ["x := y + 1", 'import "crypto/rsa"', "k, err := rsa.GenerateKey(rand.Reader, 2048)", "// c, _ := des.NewCipher(key)", "c, _ := des.NewCipher(key)", 'import "crypto/elliptic"'],
    "JavaScript": ["const n = rows.length;", "crypto.generateKeyPair('rsa', { modulusLength: 4096 }, done);", "// const s = crypto.createSign('SHA256');", "const s = crypto.createSign('SHA256');", "const e = crypto.createECDH('secp256k1');", "const api_key = 'QUJDREVGR0hJSktMTU5PUFFSU1Q=';"],
    "C/C++": ["int i = 0;", "RSA *r = RSA_new();", "/* MD5_Init(&ctx); */ i = 1;", "MD5_Init(&ctx);", "EVP_EncryptInit_ex(c, EVP_aes_128_cbc(), 0, k, iv);", "EC_KEY *e = EC_KEY_new();"],
    "Rust": ["let n = 5;", "use rsa::RsaPrivateKey;", "// use sha1::Sha1;", "let h = Sha1::new();", "use p256::ecdsa::SigningKey;"],
    "Config": ["listen 443 ssl;", "ssl_protocols TLSv1 TLSv1.2;", "# ssl_ciphers RC4-SHA;", "ssl_ciphers HIGH:RC4-SHA;", "host_key /etc/ssh/id_rsa"],
    "Text": ["plain words only", "a note about RSA and MD5"],
}
LANGUAGES = [(i, name, ext) for i, (name, ext) in enumerate([("Python", ".py"), ("Java", ".java"), ("Go", ".go"), ("JavaScript", ".js"), ("C/C++", ".c"), ("Rust", ".rs"), ("Config", ".conf"), ("Text", ".txt")])]
TEMPLATES = [(lang, i, len(lines), text) for lang, lines in _OWN.items() for i, text in enumerate(lines)]

TABLES: dict[str, tuple[str, list[tuple]]] = {
    "severities": ("severity string, weight long, rank long", SEVERITIES),
    "replacements": ("algorithm string, replacement string", REPLACEMENTS),
    "base_risk": ("algorithm string, base double", BASE_RISK),
    "size_risk": ("size long, factor double", SIZE_RISK),
    "shor": ("algorithm string", [(a,) for a in SHOR]),
    "deadlines": ("deadline_key string, deadline string", DEADLINES),
    "compliance": ("framework string, algorithm string, status string, deadline_key string", COMPLIANCE),
    "cbom": ("algorithm string, primitive string, family string", CBOM),
    "classical_bits": ("algorithm string, bits long", CLASSICAL_BITS),
    "package_algorithms": ("package string, algorithms string", PACKAGE_ALGORITHMS),
    "algorithm_states": ("algorithm string, state string", ALGORITHM_STATES),
    "gates": ("gate string, condition string, kind string, threshold string", GATES),
    "ready_shor": ("algorithm string", [(a,) for a in READY_SHOR]),
    "ready_grover": ("algorithm string", [(a,) for a in READY_GROVER]),
    "effort": ("algorithm string, hours double, kind string", EFFORT),
    "packages": ("ecosystem string, package string, risk string", PACKAGES),
    "languages": ("lang_no long, language string, ext string", LANGUAGES),
    "templates": ("language string, template_no long, n_templates long, text string", TEMPLATES),
}


def frame(spark: SparkSession, name: str) -> DataFrame:
    """A reference table as a local relation of the plan; all are a few dozen rows of fixed literals, so joins with them broadcast."""
    schema, rows = TABLES[name]
    columns = [c.split() for c in schema.split(", ")]
    text = lambda v: "NULL" if v is None else "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" if isinstance(v, str) else repr(v)
    body = ", ".join("(" + ", ".join(text(v) for v in r) + ")" for r in rows)
    kinds = {"string": "STRING", "long": "BIGINT", "double": "DOUBLE"}
    return spark.sql(f"SELECT {', '.join(f'CAST({c} AS {kinds[k]}) AS {c}' for c, k in columns)} FROM VALUES {body} AS t({', '.join(c for c, _ in columns)})")


def literal(value) -> str:
    if value is None:
        return "NULL"
    return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else repr(value)


def values_sql(name: str) -> str:
    """The same table as a SQL common table expression for the oracle."""
    schema, rows = TABLES[name]
    kinds = {"string": "VARCHAR", "long": "BIGINT", "double": "DOUBLE"}
    columns = [c.split() for c in schema.split(", ")]
    body = ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows)
    casts = ", ".join(f"CAST({c} AS {kinds[k]}) AS {c}" for c, k in columns)
    return f"{name} AS (SELECT {casts} FROM (VALUES {body}) AS t({', '.join(c for c, _ in columns)}))"
