"""Plain restatements of the operators' results, for small inputs."""

# ruff: noqa: E701, E702

import hashlib
import re

W7=re.compile(r'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')
LOW={c:c+32 for c in range(65,91)}
def low(t): return (t or '').translate(LOW)
def brute7(docs, bench, k=10):
    wins={}
    for i,t in bench:
        w=W7.findall(low(t))
        if not w: continue
        for j in range(max(1,len(w)-k+1)):
            wins.setdefault(tuple(w[j:j+k]),set()).add(i)
    lens={len(x) for x in wins}
    out={}
    for d,t in docs:
        w=W7.findall(low(t)); hit=[0]*len(w); it=set()
        for L in lens:
            for j in range(len(w)-L+1):
                x=wins.get(tuple(w[j:j+L]))
                if x is not None:
                    it|={str(i) for i in x if i is not None}
                    for q in range(j,j+L): hit[q]=1
        out[d]=(len(w),sum(hit),len(it),hashlib.sha256(','.join(sorted(it)).encode()).hexdigest(),sum(hit)>0)
    return out
W=re.compile(r'[^\x20\x09-\x0D]+')
def brute8(t):
    t=t or ''; w=W.findall(t)
    lines=[l for l in t.split('\n') if W.search(l)]
    c={}
    for j in range(len(w)-7): c.setdefault(tuple(w[j:j+8]),[]).append(j)
    cov=set()
    for v in c.values():
        if len(v)>1:
            for j in v: cov.update(range(j,j+8))
    return (len(w),sum(map(len,w)),sum(x in '#*$%&|<>' for x in t),len(lines)-len(set(lines)),len(cov), len(w)<20 or 100*len(cov)>30*len(w))
def brute1(t):
    t=t or ''; sp=[]
    ass=re.compile(r'''(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)''')
    for m in ass.finditer(t):
        if len(m[2])>=12: sp.append((m.start(),0,m.end()))
    for m in re.finditer('AKIA[A-Z0-9]+',t):
        if len(m[0])>=18: sp.append((m.start(),1,m.end()))
    for m in re.finditer('[0-9a-f]+',t):
        if len(m[0])>=16: sp.append((m.start(),2,m.end()))
    sp.sort(); n=('assign','access','hex')
    return tuple(sum(x[1]==k for x in sp) for k in range(3))+(hashlib.sha256(','.join(f'{n[k]}:{a}:{b}' for a,k,b in sp).encode()).hexdigest(),)
def brute5(docs, span=400):
    import collections
    c=collections.Counter(); B={d:(t or '').encode() for d,t in docs}
    for b in B.values():
        for i in range(len(b)-span+1): c[hash(b[i:i+span])]+=1
    out={}
    for d,b in B.items():
        m=bytearray(len(b)); e=0
        for i in range(len(b)-span+1):
            if c[hash(b[i:i+span])]>1:
                for j in range(max(i,e),i+span): m[j]=1
                e=i+span
        kept=bytes(x for x,y in zip(b,m) if not y)
        runs=sum(1 for i in range(len(m)) if m[i] and (i==0 or not m[i-1]))
        out[d]=(len(b),sum(m),runs,hashlib.sha256(kept).hexdigest())
    return out
def brute3(docs, pct=75):
    S={}
    for d,t in docs:
        w=W.findall(low(t)); 
        S[d]={tuple(w[i:i+5]) for i in range(len(w)-4)} if len(w)>=5 else ({tuple(w)} if w else set())
    inv={}
    for d,s in S.items():
        for x in s: inv.setdefault(x,[]).append(d)
    P={d:d for d in S}
    def f(x):
        while P[x]!=x: P[x]=P[P[x]]; x=P[x]
        return x
    import collections
    for d,s in S.items():
        c=collections.Counter()
        for x in s:
            for e in inv[x]:
                if e>d: c[e]+=1
        for e,k in c.items():
            if 100*k>=pct*(len(s)+len(S[e])-k):
                a,b=f(d),f(e); P[max(a,b)]=min(a,b)
    return {d:(len(S[d]),f(d)) for d in S}


def brute2(docs, min_len=40, min_docs=5):
    strip = lambda x: x.strip(' \t\n\x0b\f\r').translate(LOW)
    held = {}
    for d, t in docs:
        for line in (t or '').split('\n'):
            if len(strip(line)) >= min_len: held.setdefault(strip(line), set()).add(d)
    last = {k: max(v) for k, v in held.items() if len(v) >= min_docs}
    out = []
    for d, t in docs:
        lines = (t or '').split('\n')
        kept = [x for x in lines if last.get(strip(x), d) == d]
        out.append((d, len(lines), len(lines) - len(kept), hashlib.sha256('\n'.join(kept).encode()).hexdigest()))
    return sorted(out)


def luhn(s):
    n = [int(c) for c in s][::-1]
    return sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(n)) % 10 == 0


def brute9(t):
    t = t or ''; sp = []
    for m in re.finditer(r'[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+', t): sp.append((m.start(), 0, m.end()))
    for m in re.finditer(r'[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)', t):
        if all(int(p) <= 255 for p in m[0].split('.')): sp.append((m.start(), 1, m.end()))
    for m in re.finditer(r'[0-9]([\x20-]?[0-9])+', t):
        d = re.sub('[^0-9]', '', m[0])
        if 14 <= len(d) <= 19 and luhn(d): sp.append((m.start(), 2, m.end()))
    for m in re.finditer(r'\+[0-9][\x20().0-9-]+[0-9]', t):
        if 10 <= len(re.sub('[^0-9]', '', m[0])) <= 15: sp.append((m.start(), 3, m.end()))
    sp.sort(); n = ('email', 'ip', 'card', 'phone')
    return tuple(sum(x[1] == k for x in sp) for k in range(4)) + (hashlib.sha256(','.join(f'{n[k]}:{a}:{b}' for a, k, b in sp).encode()).hexdigest(),)
