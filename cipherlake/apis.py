"""Reference tables of cryptographic calls by language: fixed values, kept apart from dims for their length.

Rows are (module, function, algorithm, severity, category); the first row that matches a call wins.
"""

from __future__ import annotations

# Calls on an object in Python's syntax tree (object, function, ...), modules of imported names, hash functions, algorithm names in strings.
PYTHON_CALLS = [
    ("rsa", "generate_private_key", "RSA", "CRITICAL", "key_exchange"), ("rsa", "RSAPrivateKey", "RSA", "CRITICAL", "key_exchange"), ("ec", "generate_private_key", "ECDSA", "CRITICAL", "signature"), ("ec", "ECDSA", "ECDSA", "CRITICAL", "signature"), ("ec", "ECDH", "ECDH", "CRITICAL", "key_exchange"), ("dsa", "generate_private_key", "DSA", "CRITICAL", "signature"), ("dh", "generate_parameters", "DH", "CRITICAL", "key_exchange"), ("ed25519", "Ed25519PrivateKey", "Ed25519", "HIGH", "signature"),
    ("RSA", "generate", "RSA", "CRITICAL", "key_exchange"), ("RSA", "import_key", "RSA", "HIGH", "key_exchange"), ("ECC", "generate", "ECDSA", "CRITICAL", "signature"), ("DSA", "generate", "DSA", "CRITICAL", "signature"), ("DES", "new", "3DES", "HIGH", "symmetric"), ("DES3", "new", "3DES", "HIGH", "symmetric"), ("Blowfish", "new", "Blowfish", "HIGH", "symmetric"), ("ARC4", "new", "RC4", "HIGH", "symmetric"),
]
PYTHON_MODULES = [
    ("cryptography.hazmat.primitives.asymmetric.rsa", "RSA", "CRITICAL", "key_exchange"), ("cryptography.hazmat.primitives.asymmetric.ec", "ECDSA", "CRITICAL", "signature"), ("cryptography.hazmat.primitives.asymmetric.dsa", "DSA", "CRITICAL", "signature"), ("cryptography.hazmat.primitives.asymmetric.dh", "DH", "CRITICAL", "key_exchange"), ("cryptography.hazmat.primitives.asymmetric.ed25519", "Ed25519", "HIGH", "signature"), ("cryptography.hazmat.primitives.asymmetric.ed448", "Ed448", "HIGH", "signature"),
    ("Crypto.PublicKey.RSA", "RSA", "CRITICAL", "key_exchange"), ("Crypto.PublicKey.ECC", "ECDSA", "CRITICAL", "signature"), ("Crypto.PublicKey.DSA", "DSA", "CRITICAL", "signature"), ("Crypto.Cipher.DES", "3DES", "HIGH", "symmetric"), ("Crypto.Cipher.DES3", "3DES", "HIGH", "symmetric"), ("Crypto.Cipher.Blowfish", "Blowfish", "HIGH", "symmetric"), ("Crypto.Cipher.ARC4", "RC4", "HIGH", "symmetric"),
]
PYTHON_HASHES = {"md5": ("MD5", "HIGH", "hash"), "sha1": ("SHA-1", "MEDIUM", "hash")}
PYTHON_STRINGS = {"rsa": ("RSA", "HIGH", "key_exchange"), "dsa": ("DSA", "HIGH", "signature"), "ecdsa": ("ECDSA", "HIGH", "signature"), "des": ("3DES", "HIGH", "symmetric"), "3des": ("3DES", "HIGH", "symmetric"), "blowfish": ("Blowfish", "HIGH", "symmetric"), "rc4": ("RC4", "HIGH", "symmetric"), "md5": ("MD5", "HIGH", "hash"), "sha-1": ("SHA-1", "MEDIUM", "hash"), "sha1": ("SHA-1", "MEDIUM", "hash")}

# Algorithm names in string arguments of other languages, and modes of ciphers in the order in which they are looked for.
STRINGS = [
    ("rsa", "RSA", "CRITICAL", "key_exchange"), ("dsa", "DSA", "CRITICAL", "signature"), ("ecdsa", "ECDSA", "CRITICAL", "signature"), ("ecdh", "ECDH", "CRITICAL", "key_exchange"), ("diffie-hellman", "DH", "CRITICAL", "key_exchange"), ("diffiehellman", "DH", "CRITICAL", "key_exchange"), ("des", "3DES", "HIGH", "symmetric"), ("3des", "3DES", "HIGH", "symmetric"), ("desede", "3DES", "HIGH", "symmetric"), ("blowfish", "Blowfish", "HIGH", "symmetric"), ("rc4", "RC4", "HIGH", "symmetric"), ("md5", "MD5", "HIGH", "hash"), ("sha-1", "SHA-1", "MEDIUM", "hash"), ("sha1", "SHA-1", "MEDIUM", "hash"),
]

# Calls of the other languages.
JAVA = [
    ("KeyPairGenerator", "getInstance", "RSA", "CRITICAL", "key_exchange"), ("Cipher", "getInstance", "RSA", "CRITICAL", "key_exchange"), ("Signature", "getInstance", "RSA/ECDSA", "HIGH", "signature"), ("KeyAgreement", "getInstance", "ECDH/DH", "CRITICAL", "key_exchange"), ("MessageDigest", "getInstance", "SHA-1/MD5", "MEDIUM", "hash"),
    ("KeyGenerator", "getInstance", "DES", "HIGH", "symmetric"), ("SecretKeyFactory", "getInstance", "DES", "HIGH", "symmetric"), ("Mac", "getInstance", "HMAC", "MEDIUM", "hash"), ("KeyStore", "getInstance", "RSA", "HIGH", "key_exchange"), ("CertificateFactory", "getInstance", "X.509", "MEDIUM", "key_exchange"), ("SSLContext", "getInstance", "TLS", "MEDIUM", "protocol"), ("AlgorithmParameters", "getInstance", "DH", "HIGH", "key_exchange"),
    ("", "RSAEngine", "RSA", "CRITICAL", "key_exchange"), ("", "DSASigner", "DSA", "CRITICAL", "signature"), ("", "ECDSASigner", "ECDSA", "CRITICAL", "signature"),
]
GO = [
    ("crypto/rsa", "GenerateKey", "RSA", "CRITICAL", "key_exchange"), ("crypto/rsa", "SignPKCS1v15", "RSA", "CRITICAL", "signature"), ("crypto/rsa", "SignPSS", "RSA", "CRITICAL", "signature"), ("crypto/rsa", "EncryptOAEP", "RSA", "CRITICAL", "key_exchange"), ("crypto/rsa", "EncryptPKCS1v15", "RSA", "CRITICAL", "key_exchange"),
    ("crypto/ecdsa", "GenerateKey", "ECDSA", "CRITICAL", "signature"), ("crypto/ecdsa", "Sign", "ECDSA", "CRITICAL", "signature"), ("crypto/ecdsa", "SignASN1", "ECDSA", "CRITICAL", "signature"), ("crypto/dsa", "GenerateParameters", "DSA", "CRITICAL", "signature"), ("crypto/dsa", "GenerateKey", "DSA", "CRITICAL", "signature"),
    ("crypto/des", "NewCipher", "DES", "CRITICAL", "symmetric"), ("crypto/des", "NewTripleDESCipher", "3DES", "HIGH", "symmetric"), ("crypto/rc4", "NewCipher", "RC4", "HIGH", "symmetric"), ("crypto/elliptic", "P256", "ECDH", "CRITICAL", "key_exchange"), ("crypto/elliptic", "P384", "ECDH", "CRITICAL", "key_exchange"), ("crypto/elliptic", "P521", "ECDH", "CRITICAL", "key_exchange"),
    ("crypto/ed25519", "GenerateKey", "Ed25519", "HIGH", "signature"), ("crypto/ed25519", "Sign", "Ed25519", "HIGH", "signature"), ("crypto/sha1", "New", "SHA-1", "MEDIUM", "hash"), ("crypto/md5", "New", "MD5", "HIGH", "hash"), ("crypto/x509", "ParseCertificate", "X.509", "MEDIUM", "key_exchange"), ("crypto/tls", "Config", "TLS", "MEDIUM", "protocol"),
]
JAVASCRIPT = [
    ("crypto", "createSign", "RSA/ECDSA", "HIGH", "signature"), ("crypto", "createVerify", "RSA/ECDSA", "HIGH", "signature"), ("crypto", "generateKeyPair", "RSA", "CRITICAL", "key_exchange"), ("crypto", "generateKeyPairSync", "RSA", "CRITICAL", "key_exchange"), ("crypto", "createDiffieHellman", "DH", "CRITICAL", "key_exchange"), ("crypto", "createDiffieHellmanGroup", "DH", "CRITICAL", "key_exchange"), ("crypto", "createECDH", "ECDH", "CRITICAL", "key_exchange"),
    ("crypto", "createHash", "SHA-1/MD5", "MEDIUM", "hash"), ("crypto", "createHmac", "HMAC", "MEDIUM", "hash"), ("crypto", "createCipheriv", "DES", "HIGH", "symmetric"), ("crypto", "createDecipheriv", "DES", "HIGH", "symmetric"), ("crypto", "privateEncrypt", "RSA", "HIGH", "key_exchange"), ("crypto", "publicEncrypt", "RSA", "HIGH", "key_exchange"), ("crypto", "privateDecrypt", "RSA", "HIGH", "key_exchange"), ("crypto", "publicDecrypt", "RSA", "HIGH", "key_exchange"),
    ("subtle", "generateKey", "RSA", "CRITICAL", "key_exchange"), ("subtle", "importKey", "RSA", "HIGH", "key_exchange"), ("subtle", "sign", "RSA/ECDSA", "HIGH", "signature"), ("subtle", "encrypt", "RSA", "HIGH", "key_exchange"), ("jsonwebtoken", "sign", "RSA", "HIGH", "signature"), ("jose", "SignJWT", "RSA", "HIGH", "signature"),
]
RUST = [
    ("rsa", "RsaPrivateKey", "RSA", "CRITICAL", "key_exchange"), ("rsa", "RsaPublicKey", "RSA", "HIGH", "key_exchange"), ("rsa", "Pkcs1v15Sign", "RSA", "CRITICAL", "signature"), ("rsa", "Oaep", "RSA", "CRITICAL", "key_exchange"), ("p256", "SecretKey", "ECDSA", "CRITICAL", "signature"), ("p256", "SigningKey", "ECDSA", "CRITICAL", "signature"), ("p384", "SecretKey", "ECDSA", "CRITICAL", "signature"), ("k256", "SecretKey", "ECDSA", "CRITICAL", "signature"),
    ("ed25519_dalek", "SigningKey", "Ed25519", "HIGH", "signature"), ("ed25519_dalek", "Keypair", "Ed25519", "HIGH", "signature"), ("x25519_dalek", "EphemeralSecret", "X25519", "HIGH", "key_exchange"), ("x25519_dalek", "StaticSecret", "X25519", "HIGH", "key_exchange"), ("dsa", "SigningKey", "DSA", "CRITICAL", "signature"), ("sha1", "Sha1", "SHA-1", "MEDIUM", "hash"), ("md5", "Md5", "MD5", "HIGH", "hash"), ("md4", "Md4", "MD4", "HIGH", "hash"),
    ("des", "Des", "3DES", "HIGH", "symmetric"), ("des", "TdesEde3", "3DES", "HIGH", "symmetric"), ("blowfish", "Blowfish", "Blowfish", "HIGH", "symmetric"), ("rc4", "Rc4", "RC4", "HIGH", "symmetric"),
]
C = [("", "RSA_generate_key_ex", "RSA", "CRITICAL", "key_exchange"), ("", "RSA_new", "RSA", "CRITICAL", "key_exchange"), ("", "EC_KEY_generate_key", "ECDSA", "CRITICAL", "signature"), ("", "EC_KEY_new", "ECDSA", "CRITICAL", "signature"), ("", "DH_generate_parameters_ex", "DH", "CRITICAL", "key_exchange"), ("", "EVP_des_ede3_cbc", "3DES", "HIGH", "symmetric"), ("", "EVP_sha1", "SHA-1", "MEDIUM", "hash"), ("", "EVP_md5", "MD5", "HIGH", "hash"), ("", "EVP_aes_128_cbc", "AES-128", "MEDIUM", "symmetric"), ("", "EVP_aes_128_gcm", "AES-128", "MEDIUM", "symmetric")]
CSHARP = [("RSA", "Create", "RSA", "CRITICAL", "key_exchange"), ("", "RSACryptoServiceProvider", "RSA", "CRITICAL", "key_exchange"), ("ECDsa", "Create", "ECDSA", "CRITICAL", "signature"), ("ECDiffieHellman", "Create", "ECDH", "CRITICAL", "key_exchange"), ("DSA", "Create", "DSA", "CRITICAL", "signature"), ("TripleDES", "Create", "3DES", "HIGH", "symmetric"), ("MD5", "Create", "MD5", "HIGH", "hash"), ("SHA1", "Create", "SHA-1", "MEDIUM", "hash")]
RUBY = [("OpenSSL::PKey", "RSA", "RSA", "CRITICAL", "key_exchange"), ("OpenSSL::PKey", "EC", "ECDSA", "CRITICAL", "signature"), ("OpenSSL::PKey", "DH", "DH", "CRITICAL", "key_exchange"), ("OpenSSL", "Cipher", "3DES", "HIGH", "symmetric"), ("Digest", "MD5", "MD5", "HIGH", "hash"), ("Digest", "SHA1", "SHA-1", "MEDIUM", "hash")]
PHP = [("", "openssl_pkey_new", "RSA", "CRITICAL", "key_exchange"), ("", "openssl_sign", "RSA/ECDSA", "HIGH", "signature"), ("", "openssl_encrypt", "RSA", "HIGH", "key_exchange"), ("", "md5", "MD5", "HIGH", "hash"), ("", "sha1", "SHA-1", "MEDIUM", "hash"), ("", "mcrypt_encrypt", "3DES", "HIGH", "symmetric")]
KOTLIN = [("Cipher", "getInstance", "RSA", "CRITICAL", "key_exchange"), ("KeyPairGenerator", "getInstance", "RSA", "CRITICAL", "key_exchange"), ("MessageDigest", "getInstance", "SHA-1/MD5", "MEDIUM", "hash"), ("Signature", "getInstance", "RSA/ECDSA", "HIGH", "signature")]
SWIFT = [("", "SecKeyCreateRandomKey", "RSA", "CRITICAL", "key_exchange"), ("P256", "Signing", "ECDSA", "CRITICAL", "signature"), ("P256", "KeyAgreement", "ECDH", "CRITICAL", "key_exchange"), ("Curve25519", "Signing", "Ed25519", "HIGH", "signature"), ("", "CC_MD5", "MD5", "HIGH", "hash"), ("", "CC_SHA1", "SHA-1", "MEDIUM", "hash")]
BY_LANGUAGE = {"Java": JAVA, "Go": GO, "JavaScript": JAVASCRIPT, "Rust": RUST, "C/C++": C, "C#": CSHARP, "Ruby": RUBY, "PHP": PHP, "Kotlin": KOTLIN, "Scala": KOTLIN, "Swift": SWIFT}

# Parts of a node's name that make it a sink, in order, with the algorithm; parts that make a node an entry point.
SINKS = [
    ("generate_private_key", "RSA/ECDSA"), ("generate_key", "RSA/ECDSA"), ("RSA.generate", "RSA"), ("RSA.import_key", "RSA"), ("ECC.generate", "ECDSA"), ("ECDSA", "ECDSA"), ("ECDH", "ECDH"), ("Ed25519PrivateKey", "Ed25519"), ("X25519PrivateKey", "X25519"), ("generate_parameters", "DH"), ("md5", "MD5"), ("sha1", "SHA-1"), ("DES.new", "3DES"), ("DES3.new", "3DES"), ("Blowfish.new", "Blowfish"), ("ARC4.new", "RC4"), ("SSLContext", "TLS"), ("create_default_context", "TLS"), ("jwt.encode", "RSA/ECDSA"), ("jwt.decode", "RSA/ECDSA"),
]
ENTRY_NAMES = ["main", "__main__", "app.", "handle_", "view_", "endpoint", "route", "api_", "test_"]
