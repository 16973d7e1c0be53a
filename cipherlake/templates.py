"""Tier-2 fixes: code templates that a person has to review."""

from __future__ import annotations

# Fixed values: (extension, pattern with the indentation as its first group, algorithm before, algorithm after, lines of the replacement).
# Each line stands behind the indentation; {original} is the line found. The first template of an extension that is found wins.
TEMPLATES = [
    (".py", r"(\s*).*rsa\.generate_private_key\s*\(", "RSA", "ML-KEM-768 (hybrid)", ["# REVIEW-REQUIRED: PQC migration — RSA → ML-KEM-768", "# Original: {original}", "from oqs import KeyEncapsulation  # pip install liboqs-python", 'kem = KeyEncapsulation("ML-KEM-768")', "pqc_public_key = kem.generate_keypair()", "# Encapsulate: ciphertext, shared_secret = kem.encap_secret(peer_pk)", "# Decapsulate: shared_secret = kem.decap_secret(ciphertext)"]),
    (".py", r"(\s*).*ec\.ECDSA\(", "ECDSA", "ML-DSA-65", ["# REVIEW-REQUIRED: PQC migration — ECDSA → ML-DSA-65", "# Original: {original}", "from oqs import Signature  # pip install liboqs-python", 'signer = Signature("ML-DSA-65")', "pqc_public_key = signer.generate_keypair()", "# Sign: signature = signer.sign(message)", "# Verify: is_valid = signer.verify(message, signature, pqc_public_key)"]),
    (".py", r"(\s*).*ec\.ECDH\(", "ECDH", "ML-KEM-768", ["# REVIEW-REQUIRED: PQC migration — ECDH → ML-KEM-768", "# Original: {original}", "from oqs import KeyEncapsulation  # pip install liboqs-python", 'kem = KeyEncapsulation("ML-KEM-768")', "pqc_public_key = kem.generate_keypair()", "# Encapsulate: ciphertext, shared_secret = kem.encap_secret(peer_pk)"]),
    (".py", r"(\s*).*dsa\.generate_private_key\s*\(", "DSA", "ML-DSA-65", ["# REVIEW-REQUIRED: PQC migration — DSA → ML-DSA-65", "# Original: {original}", "from oqs import Signature  # pip install liboqs-python", 'signer = Signature("ML-DSA-65")', "pqc_public_key = signer.generate_keypair()"]),
    (".java", r'(\s*).*KeyPairGenerator\.getInstance\s*\(\s*"RSA"\s*\)', "RSA", "ML-KEM-768 (BouncyCastle)", ["// REVIEW-REQUIRED: PQC migration — RSA → ML-KEM-768", "// Original: {original}", "Security.addProvider(new BouncyCastleProvider());", 'KeyPairGenerator kpg = KeyPairGenerator.getInstance("ML-KEM", "BC");', "kpg.initialize(new MLKEMParameterSpec(MLKEMParameterSpec.ml_kem_768));", "KeyPair pqcKeyPair = kpg.generateKeyPair();"]),
    (".java", r'(\s*).*Cipher\.getInstance\s*\(\s*"RSA[^"]*"\s*\)', "RSA", "ML-KEM-768 + AES-GCM (hybrid)", ["// REVIEW-REQUIRED: PQC migration — RSA cipher → ML-KEM + AES-GCM", "// Original: {original}", "// Step 1: ML-KEM key encapsulation for shared secret", 'KeyPairGenerator kemKpg = KeyPairGenerator.getInstance("ML-KEM", "BC");', "kemKpg.initialize(new MLKEMParameterSpec(MLKEMParameterSpec.ml_kem_768));", "// Step 2: Use shared secret with AES-GCM for data encryption", 'Cipher cipher = Cipher.getInstance("AES/GCM/NoPadding");']),
    (".java", r'(\s*).*Signature\.getInstance\s*\(\s*".*EC[^"]*"\s*\)', "ECDSA", "ML-DSA-65 (BouncyCastle)", ["// REVIEW-REQUIRED: PQC migration — ECDSA → ML-DSA-65", "// Original: {original}", "Security.addProvider(new BouncyCastleProvider());", 'Signature sig = Signature.getInstance("ML-DSA", "BC");']),
    (".go", r"(\s*).*rsa\.GenerateKey\s*\(", "RSA", "ML-KEM-768 (circl)", ["// REVIEW-REQUIRED: PQC migration — RSA → ML-KEM-768", "// Original: {original}", '// import "github.com/cloudflare/circl/kem/mlkem/mlkem768"', "pqcPublicKey, pqcPrivateKey, err := mlkem768.GenerateKeyPair(rand.Reader)"]),
    (".go", r"(\s*).*ecdsa\.GenerateKey\s*\(", "ECDSA", "ML-DSA-65 (circl)", ["// REVIEW-REQUIRED: PQC migration — ECDSA → ML-DSA-65", "// Original: {original}", '// import "github.com/cloudflare/circl/sign/mldsa/mldsa65"', "pqcPublicKey, pqcPrivateKey, err := mldsa65.GenerateKey(rand.Reader)"]),
    (".cs", r"(\s*).*RSA\.Create\s*\(", "RSA", "ML-KEM-768 (BouncyCastle)", ["// REVIEW-REQUIRED: PQC migration — RSA → ML-KEM-768", "// Original: {original}", "// Install: dotnet add package BouncyCastle.Cryptography", "var kemGen = new MLKemKeyPairGenerator();", "kemGen.Init(new MLKemKeyGenerationParameters(new SecureRandom(), MLKemParameters.ml_kem_768));", "var pqcKeyPair = kemGen.GenerateKeyPair();"]),
    (".kt", r'(\s*).*KeyPairGenerator\.getInstance\s*\(\s*"RSA"\s*\)', "RSA", "ML-KEM-768 (BouncyCastle)", ["// REVIEW-REQUIRED: PQC migration — RSA → ML-KEM-768", "// Original: {original}", "Security.addProvider(BouncyCastleProvider())", 'val kpg = KeyPairGenerator.getInstance("ML-KEM", "BC")', "kpg.initialize(MLKEMParameterSpec(MLKEMParameterSpec.ml_kem_768))", "val pqcKeyPair = kpg.generateKeyPair()"]),
]
