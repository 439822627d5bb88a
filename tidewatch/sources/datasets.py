"""Well-known labelled sets as NPZ bundles: what they hold, and the digest that a bundle must have."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class DatasetInfo:
    name: str
    filename: str
    description: str = ""
    n_samples: int = 0
    n_features: int = 0
    anomaly_rate: float = 0.0
    source: str = ""
    category: str = ""
    sha256: str | None = None


# Key, file, title, rows, features, share of anomalies, origin, category, SHA-256 of the bundle.
KNOWN = [
    DatasetInfo(key, f"{file}.npz", title, rows, features, rate, origin, category, digest)
    for key, file, title, rows, features, rate, origin, category, digest in [
        ("fraud", "fraud", "Credit Card Fraud Detection", 284807, 30, 0.00173, "Kaggle Credit Card Fraud Dataset", "financial", "353b9a156b3f20e0739fafacdff76ef5cad1eeb7323be0ae71d384bf0e2594a6"),
        ("shuttle", "shuttle", "Space Shuttle", 58000, 9, 0.07, "UCI Machine Learning Repository", "engineering", "26900b0f6be45d9ddb7a402c9b2f956ceda42d23a8ca4cf4406b8bc1352823d1"),
        ("annthyroid", "annthyroid", "Thyroid Disease (ANN)", 7200, 21, 0.075, "UCI Machine Learning Repository", "medical", "e738f7c58a8740d2c4aac4c71ff49ce5e1d1aa16f44178135fc9c09df05fad1b"),
        ("breast", "breast_w", "Breast Cancer Wisconsin", 569, 30, 0.373, "UCI Machine Learning Repository", "medical", "4f37ce07dbc25ddad8178fdc6d664ab46d2d0000ee28c2787c3c7ff3c03ef9f6"),
        ("hepatitis", "hepatitis", "Hepatitis", 155, 19, 0.206, "UCI Machine Learning Repository", "medical", "4a87a2f7d8013e5bfde63294fae61ec7a612322de72f338a7f9491749025ad98"),
        ("lymphography", "lymphography", "Lymphography", 148, 18, 0.041, "UCI Machine Learning Repository", "medical", "dad977b04f4ea65b78ccd0e9f76b45175bad605165b37e63f3cc177845e67037"),
        ("mammography", "mammography", "Mammography", 11183, 6, 0.023, "UCI Machine Learning Repository", "medical", "a0308ac9712d78321073b1c2dc98dc37665c0f35c1cc33019416fe8f8d7de7ea"),
        ("thyroid", "thyroid", "Thyroid Disease", 3772, 6, 0.025, "UCI Machine Learning Repository", "medical", "8de161b3f235b7647bb0b39a836d983ff61d67bf234edac461da2d71e889cb87"),
        ("backdoor", "backdoor", "Network Backdoor", 2329, 196, 0.028, "KDD Cup 1999 Network Intrusion", "security", "164481cd9688306b0742c25e996c876ba561ee975629b9fdb53f8ee51b1ed911"),
        ("http", "http", "HTTP Network Traffic", 567498, 3, 0.004, "KDD Cup 1999 Network Intrusion", "security", "9d98710091551587f4740cfc851a6b064fff6319a337c2dc77ee6da4bcc2e02c"),
        ("smtp", "smtp", "SMTP Email Traffic", 95156, 3, 0.0003, "KDD Cup 1999 Network Intrusion", "security", "d2569fc9bc12115419e3f5b37d19921e10e6c26e5ad1e61064cfb0fbc402dfdd"),
        ("ionosphere", "ionosphere", "Ionosphere Radar", 351, 33, 0.359, "UCI Machine Learning Repository", "physics", "bca46cb0cfd1bf9ddef6cde5ad2215d54fb0189508d0d4c4eb98e788cad69001"),
        ("cardio", "cardio", "Cardiovascular Disease", 1831, 21, 0.096, "Cardiovascular Disease Dataset", "medical", "bc5009bde6930b4d298b594f31b34485a9a17210cff0e8fb00a8c3068b885a2d"),
        ("cover", "cover", "Forest Cover Type", 286048, 10, 0.009, "UCI Machine Learning Repository", "environmental", "945a097c3542ae81a551bf1c06dcad78a755d94f84fcaf1d60687e42d1a656df"),
        ("glass", "glass", "Glass Identification", 214, 9, 0.042, "UCI Machine Learning Repository", "materials", "aa7a8db1d475ba01a10488af454bc15220a3d5951b010b03b7020567d8152cdc"),
        ("letter", "letter", "Letter Recognition", 1600, 32, 0.025, "UCI Machine Learning Repository", "vision", "f986d3da80cf1fa2aea83a5ebe73b7d4800e0d4c01fdd1ae074b58d20f10d039"),
        ("magic_gamma", "magic_gamma", "MAGIC Gamma Telescope", 19020, 10, 0.352, "UCI Machine Learning Repository", "astronomy", "0be375984d7af9ea7a63b12206c240840d8b7daa3607021c5fb8756407dd86f1"),
        ("mnist", "mnist", "MNIST Handwritten Digits", 7603, 100, 0.092, "MNIST Database", "vision", "be7706272325fdd3592c1be555ae1a82f916a2f8545f4f8cbaa548ab102cc44c"),
        ("musk", "musk", "Musk Molecules", 3062, 166, 0.032, "UCI Machine Learning Repository", "chemistry", "2ed3f4392197b76a1e59116ff880c7720a4b026cf4842073a53b56fdea265017"),
        ("optdigits", "optdigits", "Optical Digit Recognition", 5216, 64, 0.029, "UCI Machine Learning Repository", "vision", "60de17a375a278ba220a7849727d998aa02b5e2f9fd17732a004bba28de4656e"),
        ("pageblocks", "pageBlocks", "Page Layout Analysis", 5473, 10, 0.107, "UCI Machine Learning Repository", "document", "10a9b4d5bb5d3b9083caab4c4062f665610eada703c3d927bf7c34b1f2d0d223"),
        ("pendigits", "pendigits", "Pen-Based Recognition", 6870, 16, 0.023, "UCI Machine Learning Repository", "vision", "c4936b89dcdad59d303020e492f763a0f54170080d787c77497609acbb9c2d79"),
        ("satimage2", "satimage2", "Satellite Image (Landsat)", 5803, 36, 0.013, "UCI Machine Learning Repository", "remote_sensing", "1b056e357f801b8b20c3f380a30224a3c4088d7ed764ec5a24828dc9b1918d6f"),
        ("stamps", "stamps", "Stamp Verification", 340, 9, 0.091, "Postage Stamp Dataset", "verification", "99fe739447284f613fa54bf2dccdb51c5120175ce6260adec6dad77576c42509"),
        ("donors", "donors", "Blood Donors", 748, 4, 0.239, "UCI Machine Learning Repository", "medical", "5824ec854465f2763b4bfe3da1ae9f25ed5433b5c6e265d42e37da4f82a58679"),
    ]
]
